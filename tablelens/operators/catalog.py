"""Tables of stored results: W4, A10 / B3, E1–E3 with J1, J4, J2 / Q1, Q2.

An analysis record is a row of the ``analyses`` table:
``id, upload_id, status, business_type, summary`` (strings),
``insights ARRAY<STRUCT<title, description, severity, category>>``,
``recommendations ARRAY<STRUCT<title, description, priority, impact>>``,
``kpis ARRAY<STRUCT<name, value DOUBLE, type, icon, description>>``,
``trends``, ``data_corrections``, ``column_stats`` (JSON text),
``raw_data_preview ARRAY<STRING>`` (JSON rows), ``created_at``, ``completed_at``.
Uploads: ``id, filename, original_name, file_type, file_size, status, created_at``.
"""

from __future__ import annotations

import json


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.text import contains_any, py_value_text, short_hash, underscores_to_blanks
from ..functions.words import (HELP_TAIL, INSIGHT_DEFAULTS, INSIGHT_HEADER, KPI_HEADER, NO_INSIGHT, NO_KPI,
                               NO_RECOMMEND, NO_SUMMARY, QUESTION_INSIGHT_WORDS, QUESTION_KPI_WORDS,
                               QUESTION_RECOMMEND_WORDS, QUESTION_SUMMARY_WORDS, RECOMMEND_HEADER,
                               RECOMMENDATION_DEFAULTS)

# ---------------------------------------------------------------------------
# W4
# ---------------------------------------------------------------------------


def latest_analyses(analyses: DataFrame, key: str = "upload_id", ts: str = "created_at",
                    tie: str = "id") -> DataFrame:
    """The newest record per ``key`` (ties: larger ``tie``).

    An aggregate with ``max_by``, partial on the map side, so one key that
    owns a third of all records is reduced before the shuffle, unlike a
    ``row_number`` window that would sort that key's rows in one task (Spark
    runs it sort-based because the value is a struct)."""
    cols = analyses.columns
    newest = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(ts), F.col(tie))).alias("_r")
    return analyses.groupBy(key).agg(newest).select("_r.*")


def recent(df: DataFrame, n: int = 50, ts: str = "created_at", tie: str = "id", offset: int = 0) -> DataFrame:
    """The ``n`` newest records after skipping ``offset`` (a top-k;
    the application's offset/limit had no order, newest first is added)."""
    ordered = df.orderBy(F.col(ts).desc(), F.col(tie).desc())
    return ordered.offset(offset).limit(n) if offset else ordered.limit(n)


# ---------------------------------------------------------------------------
# A10 / B3
# ---------------------------------------------------------------------------

def dashboard_counts(uploads: DataFrame, analyses: DataFrame, type_col: str = "business_type") -> DataFrame:
    """A10: (metric, business_type, value) — all uploads, all analyses,
    analyses per non-null business type, number of distinct types.

    All three analysis metrics derive from one grouping by type (partial
    aggregates, one row per type after the shuffle); the catalog tables are
    small next to the analysed data, so each metric reads them again rather
    than funnelling every type row through one task."""
    none = F.lit(None).cast("string")
    by_type = analyses.groupBy(type_col).agg(F.count(F.lit(1)).alias("value"))
    known = by_type.filter(F.col(type_col).isNotNull())
    totals_u = uploads.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("total_uploads").alias("metric"), none.alias("business_type"), "value")
    totals_a = by_type.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(
        F.lit("total_analyses").alias("metric"), none.alias("business_type"), "value")
    n_types = known.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("business_types").alias("metric"), none.alias("business_type"), "value")
    types = known.select(F.lit("analyses_by_type").alias("metric"), F.col(type_col).alias("business_type"), "value")
    return (totals_u.unionByName(totals_a).unionByName(n_types).unionByName(types)
            .withColumn("value", F.col("value").cast("bigint")))


def dashboard(uploads: DataFrame, analyses: DataFrame, n_recent: int = 10) -> dict[str, DataFrame]:
    """Counts plus the ``n_recent`` newest completed analyses."""
    done = analyses.filter(F.col("status") == "completed")
    cols = [c for c in ["id", "upload_id", "business_type", "summary", "status", "created_at", "completed_at"]
            if c in analyses.columns]
    return {"counts": dashboard_counts(uploads, analyses),
            "recent": recent(done, n_recent).select(*cols)}


# ---------------------------------------------------------------------------
# E1 / E2 / E3 with J1
# ---------------------------------------------------------------------------

def _or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def source_label(analyses: DataFrame, uploads: DataFrame) -> DataFrame:
    """The upload name of each analysis, else its upload id."""
    names = uploads.select(F.col("id").alias("_uid"), F.col("original_name").alias("_name"))
    return (analyses.join(names, analyses["upload_id"] == names["_uid"], "left")
            .withColumn("source_label", F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.col("upload_id")))
            .drop("_uid", "_name"))


def _explode_items(analyses: DataFrame, uploads: DataFrame, field: str, defaults: dict[str, str]) -> DataFrame:
    done = analyses.filter(F.col("status") == "completed").select("id", "upload_id", field)
    items = done.select(F.col("id").alias("analysis_id"), "upload_id",
                        F.posexplode(field).alias("position", "item"))
    labelled = source_label(items, uploads)
    return labelled.select("analysis_id", F.col("position").cast("bigint").alias("position"),
                           *[_or_default(F.col("item")[k], v).alias(k) for k, v in defaults.items()],
                           "source_label")


def explode_insights(analyses: DataFrame, uploads: DataFrame) -> DataFrame:
    """Every insight of every completed analysis, defaults filled, with its source."""
    return _explode_items(analyses, uploads, "insights", INSIGHT_DEFAULTS)


def explode_recommendations(analyses: DataFrame, uploads: DataFrame) -> DataFrame:
    """The same for recommendations."""
    return _explode_items(analyses, uploads, "recommendations", RECOMMENDATION_DEFAULTS)


def correction_lines(report: DataFrame) -> DataFrame:
    """``column — action with blanks (n rows)`` per report line."""
    pattern = W.CORRECTION_LINE.replace("{column}", "%s").replace("{action}", "%s").replace("{rows}", "%s")
    return report.withColumn("line", F.format_string(pattern, F.col("column"), underscores_to_blanks("action"),
                                                     F.col("affected_rows").cast("string")))


# ---------------------------------------------------------------------------
# J4
# ---------------------------------------------------------------------------

def question_key(scope: Column, question: Column) -> Column:
    """Key of a stored answer: scope and the first 16 hex digits of SHA-256
    of the trimmed, lower-cased question."""
    norm = F.lower(F.regexp_replace(question, r"^\s+|\s+$", ""))
    return F.concat(F.lit("chat:"), scope, F.lit(":"), short_hash(norm))


def prompt_key(system: Column, user: Column) -> Column:
    """Key of a stored model answer: the first 16 hex digits of SHA-256 over
    the system text, a vertical bar and the user text."""
    return F.concat(F.lit("prompt:"), short_hash(F.concat(system, F.lit("|"), user)))


def fresh_answers(history: DataFrame, ttl_seconds: int, now: Column) -> DataFrame:
    """Still-valid stored answers (stored less than ``ttl_seconds`` before
    ``now``), newest per key (partial aggregate, skew-safe)."""
    fresh = history.filter((F.col("created_at") <= now) &
                           (F.col("created_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds))))
    # of answers stored at the same time the last one in text order, whatever the order of rows
    newest = F.max_by(F.col("answer"), F.struct("created_at", "answer"))
    return fresh.groupBy("key").agg(newest.alias("cached_answer"))


def analysis_key(upload_id: Column) -> Column:
    """Key of a stored analysis: one per upload."""
    return F.concat(F.lit("analysis:"), upload_id)


#: Rows of one key that a task of a join takes; a key with more is split.
HOT_ROWS = 1_000_000


def hot_keys(left: DataFrame, left_key: Column, rows: int | None = None) -> dict[str, int]:
    """Keys of more than ``rows`` rows with the number of parts that brings each
    under it (one aggregate, partial before its shuffle; a table has at most its size
    over ``rows`` such keys)."""
    rows = rows or HOT_ROWS
    counted = left.select(left_key.cast("string").alias("k")).where("k is not null").groupBy("k").count().where(F.col("count") > rows)
    return {r["k"]: -(-int(r["count"]) // rows) for r in counted.collect()}


def spread_left_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: str,
                     hot: dict[str, int] | None = None) -> DataFrame:
    """Left join where one key of ``left``, or null, may hold any share of the
    rows. Keys are counted; the rows of a hot key (``hot_keys``, or given as ``hot``)
    are dealt over as many parts as its frequency asks for, and its row of ``right``, which
    is unique by key, is there once per part. Other rows of ``right`` are not
    copied. Null keys, which match nothing, are dealt over all tasks. (The optimizer cannot split
    a hot key here itself: an aggregate stands on the right side.)"""
    hot = hot_keys(left, left_key) if hot is None else hot
    number = F.monotonically_increasing_id()

    def parts(key: Column) -> Column:
        if not hot:
            return F.lit(1)
        table = F.from_json(F.lit(json.dumps(hot)), "map<string,int>")
        return F.coalesce(F.try_element_at(table, key.cast("string")), F.lit(1))

    dealt = left.withColumn("_left_key", left_key)
    # a null key has a part of its own, so null rows spread over the tasks
    dealt = dealt.withColumn("_part", F.when(F.col("_left_key").isNull(), F.pmod(number, F.lit(1 << 20)))
                             .otherwise(F.pmod(number, parts(F.col("_left_key")))).cast("int"))
    copies = right.withColumn("_copy_no", F.explode(F.sequence(F.lit(0), parts(F.col(right_key)) - 1)) if hot else F.lit(0))
    both = (F.col("_left_key") == F.col(right_key)) & (F.col("_part") == F.col("_copy_no"))
    return dealt.join(copies, both, "left").drop("_part", "_left_key", "_copy_no")


def reuse_answers(requests: DataFrame, history: DataFrame, ttl_seconds: int, now: Column,
                  scope_col: str = "analysis_id", question_col: str = "question",
                  key: Column | None = None) -> DataFrame:
    """Requests with their cache key and the reused answer when a fresh
    one exists (``reused``). ``key`` says what is reused: by default a chat
    answer (``question_key``); ``prompt_key`` and ``analysis_key`` serve stored
    model answers and analyses, each with its own lifetime."""
    key = question_key(F.col(scope_col), F.col(question_col)) if key is None else key
    keyed = requests.withColumn("key", key)
    fresh = fresh_answers(history, ttl_seconds, now).withColumnRenamed("key", "_fresh_key")
    return (spread_left_join(keyed, fresh, F.col("key"), "_fresh_key").drop("_fresh_key")
            .withColumn("reused", F.col("cached_answer").isNotNull()))


def keys_to_compute(requests: DataFrame, history: DataFrame, ttl_seconds: int, now: Column,
                    scope_col: str = "analysis_id", question_col: str = "question",
                    key: Column | None = None) -> DataFrame:
    """Distinct keys with no fresh stored answer (left anti join)."""
    key = question_key(F.col(scope_col), F.col(question_col)) if key is None else key
    keyed = requests.select(key.alias("key")).distinct()
    return keyed.join(fresh_answers(history, ttl_seconds, now), "key", "left_anti")


# ---------------------------------------------------------------------------
# J2 / Q1 / Q2
# ---------------------------------------------------------------------------

def resolve_analyses(questions: DataFrame, analyses: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """The analysis each question is about — by ``analysis_id`` when given,
    else the newest analysis of ``upload_id``; ``error`` says why none fits.

    The newest-per-upload aggregate carries only (upload, id, time); the chosen
    record is then fetched with one equi-join on its id."""
    rec_cols = ["id", "status", "summary", "kpis", "insights", "recommendations", "business_type"]
    newest = latest_analyses(analyses.select("upload_id", "created_at", "id")) \
        .select(F.col("upload_id").alias("_u_upload_id"), F.col("id").alias("_u_id"))
    has_aid = F.col("analysis_id").isNotNull() & (F.col("analysis_id") != "")
    has_uid = F.col("upload_id").isNotNull() & (F.col("upload_id") != "")
    # a question with an analysis id looks up no upload: its key is null there
    by_upload = F.when(~has_aid, F.col("upload_id"))
    hot = hot_keys(questions, by_upload)
    q = spread_left_join(questions, newest, by_upload, "_u_upload_id", hot)
    q = q.withColumn("_pick", F.when(has_aid, F.col("analysis_id")).otherwise(F.col("_u_id")))
    rec = analyses.select(*[F.col(c).alias(f"_a_{c}") for c in rec_cols])
    q = spread_left_join(q, rec, F.col("_pick"), "_a_id")
    if uploads is not None:
        known = uploads.select(F.col("id").alias("_known_upload")).distinct()
        q = spread_left_join(q, known, by_upload, "_known_upload", hot)
        upload_ok = F.col("_known_upload").isNotNull()
    else:
        upload_ok = F.lit(True)
    error = (F.when(has_aid & F.col("_a_id").isNull(), F.lit(W.ERR_ANALYSIS_NOT_FOUND))
             .when(~has_aid & ~has_uid, F.lit(W.ERR_CONTEXT_REQUIRED))
             .when(~has_aid & ~upload_ok, F.lit(W.ERR_UPLOAD_NOT_FOUND))
             .when(~has_aid & F.col("_u_id").isNull(), F.lit(W.ERR_NO_ANALYSIS))
             .when(F.col("_a_status") != "completed", F.lit(W.ERR_NOT_COMPLETED)))
    return q.select(*questions.columns, *[F.col(f"_a_{c}").alias(f"a_{c}") for c in rec_cols], error.alias("error"))


def _kpi_line(k: Column) -> Column:
    return F.concat(F.lit("  - "), F.coalesce(k["name"], F.lit("")), F.lit(": "),
                    F.coalesce(py_value_text(k["value"], k["type"] == "count"), F.lit("")))


def _insight_line(i: Column) -> Column:
    return F.concat(F.lit("  - "), F.coalesce(i["title"], F.lit("")), F.lit(": "),
                    F.coalesce(i["description"], F.lit("")))


def _rec_line(r: Column) -> Column:
    return F.concat(F.lit("  - ["), F.coalesce(r["priority"], F.lit("")), F.lit("] "),
                    F.coalesce(r["title"], F.lit("")), F.lit(": "), F.coalesce(r["description"], F.lit("")))


def _block(items: Column, header: str, line, empty: str) -> Column:
    return F.when(F.size(items) > 0,
                  F.concat(F.lit(header + "\n"), F.array_join(F.transform(items, line), "\n"))).otherwise(F.lit(empty))


def rule_answer(question: Column, summary: Column, kpis: Column, insights: Column, recs: Column) -> Column:
    """Q1: the first rule whose words occur in the lower-cased question wins."""
    q = F.lower(question)
    s = F.nullif(summary, F.lit(""))
    return (F.when(contains_any(q, QUESTION_SUMMARY_WORDS), F.coalesce(s, F.lit(NO_SUMMARY)))
            .when(contains_any(q, QUESTION_KPI_WORDS), _block(kpis, KPI_HEADER, _kpi_line, NO_KPI))
            .when(contains_any(q, QUESTION_INSIGHT_WORDS), _block(insights, INSIGHT_HEADER, _insight_line, NO_INSIGHT))
            .when(contains_any(q, QUESTION_RECOMMEND_WORDS), _block(recs, RECOMMEND_HEADER, _rec_line, NO_RECOMMEND))
            .otherwise(F.concat(F.lit("Analysis: "), F.coalesce(s, F.lit("Completed.")), F.lit("\n\n" + HELP_TAIL))))


def answer_questions(questions: DataFrame, analyses: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """J2 + Q1 over a table of questions: (question columns..., resolved
    analysis id, error, answer). Questions with an error get no answer."""
    r = resolve_analyses(questions, analyses, uploads)
    ans = rule_answer(F.col("question"), F.col("a_summary"), F.col("a_kpis"), F.col("a_insights"),
                      F.col("a_recommendations"))
    return r.select(*questions.columns, F.col("a_id").alias("resolved_analysis_id"), "error",
                    F.when(F.col("error").isNull(), ans).alias("answer"))


def chat_context(analyses: DataFrame, stats_chars: int = 3000, sample_rows: int = 10) -> DataFrame:
    """Q2: the context text of each analysis (id, context)."""
    def opt(cond: Column, txt: Column) -> Column:
        return F.when(cond, txt)

    def s(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    kp = F.col("kpis")
    ins = F.col("insights")
    rec = F.col("recommendations")
    pv = F.col("raw_data_preview")
    parts = [
        F.concat(F.lit(W.CONTEXT_TYPE), s("business_type")),
        F.concat(F.lit(W.CONTEXT_SUMMARY), s("summary")),
        opt(F.size(kp) > 0, F.concat(F.lit(W.CONTEXT_KPIS + "\n"), F.array_join(F.transform(kp, _kpi_line), "\n"))),
        opt(F.size(ins) > 0, F.concat(F.lit(W.CONTEXT_INSIGHTS + "\n"),
                                      F.array_join(F.transform(ins, _insight_line), "\n"))),
        opt(F.size(rec) > 0, F.concat(F.lit(W.CONTEXT_RECOMMENDATIONS + "\n"),
                                      F.array_join(F.transform(rec, _rec_line), "\n"))),
        opt(F.coalesce(F.length("column_stats"), F.lit(0)) > 0,
            F.concat(F.lit(W.CONTEXT_STATS + "\n"), F.substring("column_stats", 1, stats_chars))),
        opt(F.size(pv) > 0, F.concat(F.lit(W.CONTEXT_SAMPLE.format(n=sample_rows) + "\n"),
                                     F.array_join(F.transform(F.slice(pv, 1, sample_rows),
                                                              lambda r: F.concat(F.lit("  "), r)), "\n"))),
    ]
    return analyses.select("id", F.concat_ws("\n", *parts).alias("context"))


def completed(analyses: DataFrame) -> DataFrame:
    """Completed analyses only."""
    return analyses.filter(F.col("status") == "completed")


def for_upload(analyses: DataFrame, upload_id: str) -> DataFrame:
    """Analyses of one upload."""
    return analyses.filter(F.col("upload_id") == upload_id)
