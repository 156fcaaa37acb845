"""Input shapes built from the driver's tables by rules on keys only, so the
Spark side (here) and the SQL side (``sql.py``) state them alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.words import TTL_QUESTION

LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
MESSY_LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "_o_quantity", "l_extendedprice",
                        "_o_discount", "l_tax", "_o_returnflag", "l_linestatus", "l_shipdate"]
# copies of the values before nulls were put in; they only serve the order
ORIGINALS = ["_o_quantity", "_o_discount", "_o_returnflag"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def null_when(cond, col: str):
    return F.when(cond, F.lit(None)).otherwise(F.col(col)).alias(col)


def lineitem_messy(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        null_when(F.col("l_linenumber") % 3 == 0, "l_quantity"),
        "l_extendedprice",
        null_when(F.col("l_orderkey") % 5 == 0, "l_discount"),
        "l_tax",
        null_when(F.col("l_orderkey") % 11 == 0, "l_returnflag"),
        "l_linestatus", "l_shipdate",
        F.col("l_quantity").alias("_o_quantity"), F.col("l_discount").alias("_o_discount"),
        F.col("l_returnflag").alias("_o_returnflag"))


def orders_messy(spark: SparkSession, d: str) -> DataFrame:
    """Nulls in the price (keys ≡ 0, 1 mod 7) and the priority (keys ≡ 0 mod
    13); every 10th order twice, the copy after the original."""
    o = read(spark, d, "orders")
    base = o.select("o_orderkey", "o_custkey", "o_orderstatus",
                    null_when(F.col("o_orderkey") % 7 < 2, "o_totalprice"),
                    "o_orderdate",
                    null_when(F.col("o_orderkey") % 13 == 0, "o_orderpriority"))
    first = base.withColumn("_copy", F.lit(0))
    again = base.filter(F.col("o_orderkey") % 10 == 0).withColumn("_copy", F.lit(1))
    return first.unionByName(again)


def orders_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    return orders_messy(spark, d).filter(F.col("_copy") == 0).drop("_copy")


def orders_copies(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.withColumn("_copy", F.lit(0)).unionByName(
        o.filter(F.col("o_orderkey") % 10 == 0).withColumn("_copy", F.lit(1)))


def part_messy(spark: SparkSession, d: str) -> DataFrame:
    """Prices as text: ``$1,234.50``; 'n/a' for every 4th key (37 of the
    first 50 parse: 74 %, converted) or for keys ≡ 0, 1, 2 mod 10 (35 of 50:
    exactly 70 %, kept as text); sizes as ``45%``."""
    p = read(spark, d, "part")
    money = F.concat(F.lit("$"), F.format_number(F.col("p_retailprice"), 2))
    return p.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 4 == 0, F.lit("n/a")).otherwise(money).alias("price_text"),
        F.when(F.col("p_partkey") % 10 < 3, F.lit("n/a")).otherwise(money).alias("price_text_70"),
        F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("size_pct"),
        "p_name")


def events_outliers(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.withColumn("value", F.when(F.col("event_id") % 1000 == 0, F.col("value") * 1000)
                        .otherwise(F.col("value")))


def analyses(spark: SparkSession, d: str) -> DataFrame:
    """Each event plays an analysis record: ``user_id`` is the upload,
    ``event_type`` the business type (missing for ids ≡ 0 mod 17), status
    by id mod 3."""
    e = read(spark, d, "events")
    eid = F.col("event_id")
    status = F.when(eid % 3 == 0, "completed").when(eid % 3 == 1, "failed").otherwise("processing")
    insight = F.struct(F.concat(F.col("event_type"), F.lit(" insight")).alias("title"),
                       F.col("props").alias("description"),
                       F.when(eid % 2 == 0, "info").otherwise("warning").alias("severity"),
                       F.lit("Trend").alias("category"))
    blank_insight = F.struct(F.when(eid % 4 == 0, F.lit("")).otherwise(F.lit("Second look")).alias("title"),
                             F.lit(None).cast("string").alias("description"),
                             F.lit("").alias("severity"),
                             F.when(eid % 5 == 0, F.lit(None)).otherwise(F.lit("Data")).cast("string").alias("category"))
    rec = F.struct(F.concat(F.lit("Check "), F.col("event_type")).alias("title"),
                   F.col("props").alias("description"),
                   F.when(eid % 2 == 0, F.lit("high")).otherwise(F.lit("")).alias("priority"),
                   F.lit("").alias("impact"))
    kpis = F.array(
        F.struct(F.lit("value").alias("name"), F.col("value").cast("double").alias("value"),
                 F.lit("number").alias("type"), F.lit("sum").alias("icon"),
                 F.lit(None).cast("string").alias("description")),
        F.struct(F.lit("user").alias("name"), F.col("user_id").cast("double").alias("value"),
                 F.lit("count").alias("type"), F.lit("hash").alias("icon"),
                 F.lit(None).cast("string").alias("description")))
    return e.select(
        eid.cast("string").alias("id"),
        F.col("user_id").cast("string").alias("upload_id"),
        status.alias("status"),
        F.when(eid % 17 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("business_type"),
        F.when(eid % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Events of type "), F.col("event_type")))
        .alias("summary"),
        F.array(insight, blank_insight).alias("insights"),
        F.when(eid % 6 == 5, F.array().cast("array<struct<title:string,description:string,priority:string,"
                                           "impact:string>>")).otherwise(F.array(rec)).alias("recommendations"),
        F.when(eid % 8 == 7, F.lit(None).cast("array<struct<name:string,value:double,type:string,icon:string,"
                                              "description:string>>"))
        .otherwise(kpis).alias("kpis"),
        F.col("ts").alias("created_at"))


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """One upload per user: name ``file_<user>.csv``, blank for users ≡ 0
    mod 9, no upload at all for users ≡ 0 mod 13."""
    e = read(spark, d, "events")
    u = e.groupBy("user_id").agg(F.min("ts").alias("created_at"))
    return u.filter(F.col("user_id") % 13 != 0).select(
        F.col("user_id").cast("string").alias("id"),
        F.when(F.col("user_id") % 9 == 0, F.lit("")).otherwise(
            F.concat(F.lit("file_"), F.col("user_id").cast("string"), F.lit(".csv"))).alias("original_name"),
        "created_at")


QUESTION_PREFIX = ["summary: ", "show kpi: ", "any insight? ", "what should we do? ", ""]


def questions(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").filter(F.col("role") == "user")
    prefix = F.element_at(F.array(*[F.lit(p) for p in QUESTION_PREFIX]), (F.col("conv_id") % 5 + 1).cast("int"))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        F.concat(prefix, F.col("text")).alias("question"),
        F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string")).alias("analysis_id"),
        F.when(F.col("conv_id") % 3 != 1, (F.col("conv_id") % 150).cast("string")).alias("upload_id"))


def chat_requests(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").filter(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
                    (F.col("conv_id") % 150).cast("string").alias("analysis_id"),
                    F.col("text").alias("question"))


def chat_history(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers for user turns with (conv + turn) ≡ 0 mod 3, stamped
    ``turn`` hours after 2024-01-01 (stored with blanks around the question,
    which the key ignores)."""
    from tablelens.operators.catalog import question_key
    c = read(spark, d, "conversations").filter((F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 3 == 0))
    return c.select(
        question_key((F.col("conv_id") % 150).cast("string"),
                     F.concat(F.lit(" "), F.col("text"), F.lit("\t "))).alias("key"),
        F.concat(F.lit("answer "), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("answer"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("turn").cast("int")))
        .alias("created_at"))


HISTORY_NOW = "2024-01-01 05:00:00"
HISTORY_TTL = TTL_QUESTION          # stored chat answers live 4 hours


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc, text); documents with ids ≡ 0 mod 97 are emptied."""
    doc = read(spark, d, "documents")
    return doc.select(F.col("doc_id").cast("string").alias("doc"),
                      F.when(F.col("doc_id") % 97 == 0, F.lit("")).otherwise(F.col("text")).alias("text"))


def page_uploads(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages")
    return p.select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("original_name"),
                    F.col("page_id").alias("created_at"))
