"""P1 prompt context of a table; P2 ingestion of stored model responses."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, json_text, py_repr, py_text_repr
from ..functions.types import column_classes
from .heads import head_tail, head_values
from .order import default_order
from .profile import distinct_counts

KPI_ITEM = "struct<name:string,value:double,type:string,icon:string,description:string>"
INSIGHT_ITEM = "struct<title:string,description:string,severity:string,category:string>"
RECOMMENDATION_ITEM = "struct<title:string,description:string,priority:string,impact:string>"
TREND_ITEM = "struct<column:string,direction:string,change_percent:double,description:string>"
ANALYSIS_ITEM = (f"struct<summary:string,insights:array<{INSIGHT_ITEM}>,"
                 f"recommendations:array<{RECOMMENDATION_ITEM}>,trends:array<{TREND_ITEM}>>")



def _exact_sum(c: str, dtype) -> Column:
    """A column's sum, as text, that no order of adding changes: whole numbers
    and decimals exactly; doubles through 12 decimals where all values fit."""
    if dtype.typeName() in ("long", "integer"):
        return F.sum(F.col(c).cast("decimal(38,0)")).cast("string")
    dec = F.col(c).try_cast("decimal(38,12)")
    exact = F.when(F.count(c) == F.count(dec), F.try_sum(dec).cast("double"))
    return py_repr(F.coalesce(exact, F.sum(F.col(c).cast("double"))))


def _column_line(df: DataFrame, c: str, dtype, numeric: bool, distinct: int, samples: str | None) -> Column:
    """One aggregate expression: the profile line of a column."""
    nulls = F.count_if(F.col(c).isNull())
    number = (lambda x: py_repr(x)) if dtype.typeName() in ("double", "float") else (lambda x: x.cast("string"))
    parts = [F.lit(f"  {c} (type={dtype.simpleString()}, nulls="), nulls.cast("string"), F.lit(", unique="),
             F.when(nulls > 0, F.lit(str(distinct + 1))).otherwise(F.lit(str(distinct))), F.lit(")")]
    if numeric:
        values = F.concat(F.lit(" min="), number(F.min(c)), F.lit(" max="), number(F.max(c)), F.lit(" mean="),
                          fixed(F.avg(F.col(c).cast("double")), 2), F.lit(" sum="), _exact_sum(c, dtype))
        parts.append(F.when(F.count(c) > 0, values).otherwise(F.lit("")))
    if samples is not None:
        parts.append(F.lit(f" samples=[{samples}]"))
    return F.concat(*parts)


def prompt_context(df: DataFrame, order: Sequence[str] | str | None = None) -> DataFrame:
    """The context lines of a table (line_no, text): ``DATASET``,
    ``COLUMNS``, one profile line per column, the first 15 rows and, for
    longer tables, the last 5 as JSON.

    All lines are made by Spark: the profile is one aggregate whose result row
    is an array of texts, the rows are a top-k printed cell by cell. Only the row
    count, the distinct counts and the printed samples (5 per text column) pass
    through the driver."""
    order = default_order(df, order)
    cc = column_classes(df)
    n = df.count()
    distinct = distinct_counts(df, cc.columns)
    samples: dict[str, str] = {c: "" for c in cc.text}
    if cc.text:
        heads = head_values(df, cc.text, order, 5).groupBy("column").agg(
            F.array_sort(F.collect_list(F.struct("rank", py_text_repr("value").alias("shown")))).alias("h"))
        shown = heads.select("column", F.array_join(F.transform("h", lambda x: x["shown"]), ", ").alias("line"))
        samples.update({r["column"]: r["line"] for r in shown.collect()})
    profile = [F.lit(f"DATASET: {n} rows, {len(cc.columns)} columns"), F.lit(f"COLUMNS: {', '.join(cc.columns)}"), F.lit("")]
    profile += [_column_line(df, c, cc.dtypes[c], c in cc.numeric, distinct[c], samples.get(c)) for c in cc.columns]
    profile += [F.lit(""), F.lit("FIRST 15 ROWS:")]
    top = min(n, 15)
    tail = [F.lit(""), F.lit("LAST 5 ROWS:")] if n > 15 else []
    # the heading of the last rows stands behind the first ones
    numbers = [*range(len(profile)), *range(len(profile) + top, len(profile) + top + len(tail))]
    texts = df.agg(F.array(*profile, *tail).alias("texts"))
    lines = texts.select(F.inline(F.arrays_zip(F.array(*[F.lit(k).cast("bigint") for k in numbers]).alias("line_no"),
                                               F.col("texts").alias("text"))))
    rows = head_tail(df.select(*cc.columns, *[o for o in order if o not in cc.columns]), order, 15, 5, n_rows=n)
    cells = [F.concat(F.lit(json.dumps(c, ensure_ascii=False) + ": "), json_text(c, cc.dtypes[c])) for c in cc.columns]
    first = F.when(F.col("part") == "first", F.lit(len(profile) - 1)).otherwise(F.lit(len(profile) + top + len(tail) - 1))
    printed = rows.select((first + F.col("rank")).cast("bigint").alias("line_no"),
                          F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}")).alias("text"))
    return lines.toDF("line_no", "text").unionByName(printed)


def prompt_text(df: DataFrame, order: Sequence[str] | str | None = None) -> str:
    return "\n".join(r["text"] for r in prompt_context(df, order).orderBy("line_no").collect())


def strip_fences(col: str = "text"):
    """Drop every line that starts with a code fence when the text starts with one."""
    t = F.regexp_replace(F.col(col), r"^\s+|\s+$", "")
    kept = F.array_join(F.filter(F.split(t, "\n"), lambda ln: ~F.regexp_replace(ln, r"^\s+", "").startswith("```")),
                        "\n")
    return F.when(t.startswith("```"), kept).otherwise(t)


def parse_responses(responses: DataFrame, text_col: str = "text") -> DataFrame:
    """(id, kind, kpis, business_type, summary) per stored response.

    ``kind``: ``kpis`` (object with a ``kpis`` list), ``array`` (a non-empty
    bare list), ``object`` (any other JSON object), ``fallback`` (no JSON:
    the rule-based result is used)."""
    clean = responses.withColumn("_clean", strip_fences(text_col))
    first = F.substring(F.col("_clean"), 1, 1)
    # parse only the shape the first character announces (CASE branches are lazy)
    keys = F.when(first == "{", F.json_object_keys("_clean"))
    is_obj = keys.isNotNull()
    arr_len = F.when(first == "[", F.json_array_length("_clean"))
    obj = F.from_json("_clean", f"struct<kpis:array<{KPI_ITEM}>,business_type:string,summary:string>")
    arr = F.from_json("_clean", f"array<{KPI_ITEM}>")
    kind = (F.when(is_obj & F.array_contains(keys, "kpis"), F.lit("kpis"))
            .when(F.coalesce(arr_len, F.lit(0)) > 0, F.lit("array"))
            .when(is_obj, F.lit("object"))
            .otherwise(F.lit("fallback")))
    return (clean.withColumn("kind", kind)
            .select("id", "kind",
                    F.when(F.col("kind") == "kpis", obj["kpis"]).when(F.col("kind") == "array", arr).alias("kpis"),
                    F.when(F.col("kind").isin("kpis", "object"), obj["business_type"]).alias("business_type"),
                    F.when(F.col("kind").isin("kpis", "object"), obj["summary"]).alias("summary")))


def parse_analyses(responses: DataFrame, text_col: str = "text", rule_based: DataFrame | None = None) -> DataFrame:
    """P2 for full analyses: (id, kind, summary, insights, recommendations,
    trends). A JSON object gives its fields, empty where one is missing
    (``object``); anything else is a ``fallback``, whose fields come from the row
    of ``rule_based`` (id and the same four fields) with its id, where given."""
    clean = responses.select("id", strip_fences(text_col).alias("_clean"))
    first = F.substring(F.col("_clean"), 1, 1)
    # parsed once; only what starts like an object and has keys is one
    parsed = clean.select("id", F.when((first == "{") & F.json_object_keys("_clean").isNotNull(),
                                       F.from_json("_clean", ANALYSIS_ITEM)).alias("_p"))
    fields = ["summary", "insights", "recommendations", "trends"]
    types = dict(zip(fields, ["string", f"array<{INSIGHT_ITEM}>", f"array<{RECOMMENDATION_ITEM}>", f"array<{TREND_ITEM}>"]))
    empty = {f: F.lit("") if f == "summary" else F.array().cast(types[f]) for f in fields}
    own = {f: F.coalesce(F.col("_p")[f], empty[f]) for f in fields}
    is_object = F.col("_p").isNotNull()
    if rule_based is None:
        other = {f: F.lit(None).cast(types[f]) for f in fields}
    else:
        from .catalog import spread_left_join
        rules = rule_based.select(F.col("id").alias("_rule_id"), *[F.col(f).cast(types[f]).alias(f"_r_{f}") for f in fields])
        parsed = spread_left_join(parsed, rules, F.when(~is_object, F.col("id")), "_rule_id")
        other = {f: F.col(f"_r_{f}") for f in fields}
    return parsed.select("id", F.when(is_object, F.lit("object")).otherwise(F.lit("fallback")).alias("kind"),
                         *[F.when(is_object, own[f]).otherwise(other[f]).alias(f) for f in fields])
