"""S7 analysis records (append-only) and S8 the four-part report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import parse_schema

ANALYSIS_SCHEMA = (
    "id string, upload_id string, status string, business_type string, summary string, "
    "insights array<struct<title:string,description:string,severity:string,category:string>>, "
    "recommendations array<struct<title:string,description:string,priority:string,impact:string>>, "
    "kpis array<struct<name:string,value:double,type:string,icon:string,description:string>>, "
    "trends array<struct<column:string,direction:string,change_percent:double,description:string>>, "
    "data_corrections array<struct<column:string,action:string,affected_rows:bigint>>, "
    "column_stats string, raw_data_preview array<string>, "
    "charts array<struct<type:string,title:string,x_key:string,data_keys:array<string>,name_key:string,"
    "value_format:string,data:array<string>>>, created_at timestamp, completed_at timestamp"
)


def conform(records: DataFrame) -> DataFrame:
    """Records cast to the ``analyses`` schema, columns in its order."""
    schema = parse_schema(ANALYSIS_SCHEMA)
    # records from before a field existed have it as null
    return records.select(*[(F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                            for f in schema.fields])


def write_analysis(records: DataFrame, path: str) -> None:
    """Append analysis records (a status change is a new record; the
    current state of each analysis is its newest record, see ``current_analyses``)."""
    conform(records).write.mode("append").parquet(path)


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANALYSIS_SCHEMA).parquet(path)


def current_analyses(records: DataFrame) -> DataFrame:
    """The current state of each analysis: its newest record, a finished
    record (completed / failed) winning over a processing one of the same time."""
    from ..operators.catalog import latest_analyses
    stamp = F.coalesce(F.col("completed_at"), F.col("created_at"))
    rank = F.when(F.col("status").isin("completed", "failed"), F.lit(1)).otherwise(F.lit(0))
    return (latest_analyses(records.withColumn("_stamp", F.struct(stamp.alias("t"), rank.alias("r"))),
                            key="id", ts="_stamp", tie="status")
            .drop("_stamp"))


def write_report(parts: dict[str, DataFrame], folder: str, fmt: str = "csv") -> list[str]:
    """Write the Preview, Stats, KPIs and Insights parts as folders
    (``csv`` with a header, or ``parquet``). Nested columns become JSON text for CSV."""
    written = []
    for name in ["Preview", "Stats", "KPIs", "Insights"]:
        df = parts.get(name)
        if df is None:
            continue
        out = f"{folder.rstrip('/')}/{name}"
        if fmt == "csv":
            flat = df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                               if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
                               for f in df.schema.fields])
            flat.write.mode("overwrite").option("header", True).csv(out)
        else:
            df.write.mode("overwrite").parquet(out)
        written.append(out)
    return written


def mark_analyzed(uploads: DataFrame, records: DataFrame) -> DataFrame:
    """Uploads with status ``analyzed`` where a completed analysis exists;
    other statuses stay. A completed upload has one row on the right however
    many records it has."""
    done = (records.where("status = 'completed'").select(F.col("upload_id").alias("_done")).distinct())
    joined = uploads.join(done, uploads["id"] == done["_done"], "left")
    return joined.withColumn("status", F.when(F.col("_done").isNotNull(), F.lit("analyzed"))
                             .otherwise(F.col("status"))).drop("_done")
