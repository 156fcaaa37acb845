"""Every registered query: the Spark side (library calls over the driver's
tables) and, where the operator is expressible in SQL, an independent DuckDB
statement of the same semantics. Float results are rounded alike on both
sides only where the engines' summation orders would otherwise differ in the
last bits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.functions import text as tx
from tablelens.functions.words import (CURRENCY_WORDS, DOMAIN_KEYWORDS, GENERAL_DOMAIN, HELP_TAIL, INSIGHT_HEADER,
                                       KPI_HEADER, NO_INSIGHT, NO_KPI, NO_RECOMMEND, NO_SUMMARY,
                                       QUESTION_INSIGHT_WORDS, QUESTION_KPI_WORDS, QUESTION_RECOMMEND_WORDS,
                                       QUESTION_SUMMARY_WORDS, RECOMMEND_HEADER)

from tablelens.functions.frames import rows_frame
from tablelens.operators.profile import dense_distinct_counts
from tablelens.operators.quantiles import quantiles_by_narrowing

from . import fixtures as fx
from . import sql as S

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


# ===========================================================================
# lineitem
# ===========================================================================

MESSY_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
MESSY_TYPES = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string",
               "timestamp_ntz"]
WIDE = {"bigint", "int", "double"}


@query("fill_missing", f"""
WITH {S.LINEITEM_MESSY}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       COALESCE(last_value(l_quantity IGNORE NULLS) OVER w, 0) AS l_quantity,
       l_extendedprice,
       COALESCE(last_value(l_discount IGNORE NULLS) OVER w, 0) AS l_discount,
       l_tax, COALESCE(l_returnflag, '(empty)') AS l_returnflag, l_linestatus, l_shipdate
FROM lm
WINDOW w AS (ORDER BY {S.MESSY_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_fill_missing(spark, d):
    df, _ = tl.fill_missing(fx.lineitem_messy(spark, d), fx.MESSY_LINEITEM_ORDER)
    return df.select(*MESSY_COLS)


@query("fill_missing_report", f"""
WITH {S.LINEITEM_MESSY}
SELECT * FROM (
  SELECT 'l_quantity' AS "column", 'filled_numeric_nulls' AS action, count(*) FILTER (WHERE l_quantity IS NULL) AS affected_rows FROM lm
  UNION ALL SELECT 'l_discount', 'filled_numeric_nulls', count(*) FILTER (WHERE l_discount IS NULL) FROM lm
  UNION ALL SELECT 'l_returnflag', 'filled_text_nulls', count(*) FILTER (WHERE l_returnflag IS NULL) FROM lm
) WHERE affected_rows > 0""")
def q_fill_missing_report(spark, d):
    from tablelens.operators.clean import missing_report, report_frame
    return report_frame(spark, missing_report(fx.lineitem_messy(spark, d)))


@query("forward_fill", f"""
WITH {S.LINEITEM_MESSY}
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       last_value(l_quantity IGNORE NULLS) OVER w AS l_quantity,
       l_extendedprice,
       last_value(l_discount IGNORE NULLS) OVER w AS l_discount,
       l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lm
WINDOW w AS (ORDER BY {S.MESSY_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_forward_fill(spark, d):
    df = tl.forward_fill(fx.lineitem_messy(spark, d), ["l_quantity", "l_discount"], fx.MESSY_LINEITEM_ORDER)
    return df.select(*MESSY_COLS)


@query("global_index", f"""
SELECT *, row_number() OVER (ORDER BY {S.LINEITEM_ORDER_SQL}) - 1 AS idx FROM lineitem""")
def q_global_index(spark, d):
    li = fx.read(spark, d, "lineitem")
    return tl.GlobalOrder.build(li, fx.LINEITEM_ORDER).global_index("idx")


def _column_statistics_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(zip(MESSY_COLS, MESSY_TYPES)):
        num = t in WIDE
        mean = f"round(avg(CAST({c} AS DOUBLE)), 4)" if num else "CAST(NULL AS DOUBLE)"
        lo = f"CAST(min({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        hi = f"CAST(max({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"
        sd = f"round(stddev_samp(CAST({c} AS DOUBLE)), 4)" if num else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", '{t}' AS dtype, "
                     f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
                     f"CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unique_count, "
                     f"{mean} AS mean, {lo} AS min, {hi} AS max, {sd} AS std FROM lm")
    return f"WITH {S.LINEITEM_MESSY}\n" + "\nUNION ALL ".join(parts)


@query("column_statistics", _column_statistics_sql())
def q_column_statistics(spark, d):
    st = tl.column_statistics(fx.lineitem_messy(spark, d).drop(*fx.ORIGINALS))
    return st.withColumn("mean", r4("mean")).withColumn("std", r4("std"))


@query("null_percent", f"""
WITH {S.LINEITEM_MESSY}
SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns,
       CAST({' + '.join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in MESSY_COLS)} AS BIGINT) AS null_cells,
       round(CAST({' + '.join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in MESSY_COLS)} AS DOUBLE)
             / (count(*) * 11) * 100, 4) AS null_percent
FROM lm""")
def q_null_percent(spark, d):
    return tl.null_percent(fx.lineitem_messy(spark, d).drop(*fx.ORIGINALS)).withColumn("null_percent", r4("null_percent"))


def _anomaly_sql(cte: str, table: str, cols: list[str]) -> str:
    stats = ", ".join(f"count({c}) AS n{i}, avg(CAST({c} AS DOUBLE)) AS m{i}, stddev_samp(CAST({c} AS DOUBLE)) AS s{i}"
                      for i, c in enumerate(cols))
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"SELECT '{c}' AS \"column\", 'anomalies_detected' AS action, "
                     f"(SELECT count(*) FROM {table}, st WHERE abs(CAST({c} AS DOUBLE) - m{i}) / s{i} > 3) AS affected_rows, "
                     f"n{i} >= 10 AND s{i} IS NOT NULL AND s{i} <> 0 AS ok FROM st")
    head = f"WITH {cte + ',' if cte else ''} st AS (SELECT {stats} FROM {table})\n"
    return head + "SELECT \"column\", action, CAST(affected_rows AS BIGINT) AS affected_rows FROM (" + \
        "\nUNION ALL ".join(parts) + ") WHERE ok AND affected_rows > 0"


@query("anomaly_report", _anomaly_sql("", "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                        "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def q_anomaly_report(spark, d):
    return tl.anomaly_report(fx.read(spark, d, "lineitem"))


@query("anomaly_report_events", _anomaly_sql(S.EVENTS_OUTLIERS.strip(), "eo", ["event_id", "user_id", "value"]))
def q_anomaly_report_events(spark, d):
    return tl.anomaly_report(fx.events_outliers(spark, d))


@query("flag_anomalies", f"""
WITH {S.EVENTS_OUTLIERS}, st AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM eo)
SELECT event_id, 'value' AS anomaly_column, round(abs(value - m) / s, 4) AS z_score
FROM eo, st WHERE abs(value - m) / s > 3""")
def q_flag_anomalies(spark, d):
    f = tl.flag_anomalies(fx.events_outliers(spark, d))
    return f.select("event_id", "anomaly_column", r4("z_score").alias("z_score"))


@query("numeric_summary", "\nUNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS name, {S.py_round(f'sum(CAST({c} AS DOUBLE))', 2)} AS total, "
    f"{S.py_round(f'avg(CAST({c} AS DOUBLE))', 2)} AS average FROM lineitem"
    for i, c in enumerate(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])))
def q_numeric_summary(spark, d):
    return tl.numeric_summary(fx.read(spark, d, "lineitem"))


def _describe_sql() -> str:
    cols = [("c_custkey", "num"), ("c_name", "cat"), ("c_nationkey", "num"), ("c_acctbal", "num"),
            ("c_mktsegment", "cat")]
    parts = []
    for i, (c, k) in enumerate(cols):
        if k == "num":
            x = f"CAST({c} AS DOUBLE)"
            parts.append(
                f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS count, "
                f"0.0 AS \"unique\", '0' AS top, 0.0 AS freq, round(avg({x}), 4) AS mean, "
                f"round(stddev_samp({x}), 4) AS std, min({x}) AS min, round(quantile_cont({x}, 0.25), 4) AS p25, "
                f"round(quantile_cont({x}, 0.5), 4) AS p50, round(quantile_cont({x}, 0.75), 4) AS p75, "
                f"max({x}) AS max FROM customer")
        else:
            parts.append(
                f"SELECT CAST({i} AS BIGINT), '{c}', CAST(count({c}) AS DOUBLE), CAST(count(DISTINCT {c}) AS DOUBLE), "
                f"(SELECT {c} FROM customer WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), "
                f"(SELECT CAST(count(*) AS DOUBLE) FROM customer WHERE {c} IS NOT NULL GROUP BY {c} "
                f"ORDER BY count(*) DESC, {c} LIMIT 1), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0 FROM customer")
    return "\nUNION ALL ".join(parts)


@query("describe_all", _describe_sql())
def q_describe_all(spark, d):
    out = tl.describe_all(fx.read(spark, d, "customer"), order="c_custkey")
    for c in ["mean", "std", "p25", "p50", "p75"]:
        out = out.withColumn(c, r4(c))
    return out


def _histogram_sql(table: str, col: str) -> str:
    return f"""
WITH v AS (SELECT CAST({col} AS DOUBLE) AS x FROM {table} WHERE {col} IS NOT NULL),
st AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi FROM v),
p AS (SELECT n, lo, hi, least(10, greatest(3, n // 5)) AS bins FROM st WHERE n >= 2),
w AS (SELECT *, CASE WHEN hi <> lo THEN (hi - lo) / bins ELSE 1.0 END AS width FROM p),
b AS (SELECT CAST(least(floor((x - lo) / width), bins - 1) AS BIGINT) AS bin, count(*) AS c FROM v, w GROUP BY 1),
g AS (SELECT CAST(i AS BIGINT) AS bin, lo, width FROM w, range(0, (SELECT bins FROM w)) t(i))
SELECT g.bin, printf('%.0f', lo + CAST(g.bin AS DOUBLE) * width) || '-' || printf('%.0f', lo + (CAST(g.bin AS DOUBLE) + 1.0) * width) AS range,
       CAST(COALESCE(b.c, 0) AS BIGINT) AS count
FROM g LEFT JOIN b ON g.bin = b.bin"""


@query("histogram", _histogram_sql("lineitem", "l_extendedprice"))
def q_histogram(spark, d):
    return tl.histogram(fx.read(spark, d, "lineitem"), "l_extendedprice")


@query("histogram_events", _histogram_sql("eo", "value").replace("WITH v AS", f"WITH {S.EVENTS_OUTLIERS}, v AS"))
def q_histogram_events(spark, d):
    return tl.histogram(fx.events_outliers(spark, d), "value")


def _half_trend_ctes(table: str, cols: list[str], order_sql: str) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", n, fm, sm FROM ("
            f" SELECT count(*) AS n, avg(CASE WHEN rn <= cnt // 2 THEN x END) AS fm,"
            f" avg(CASE WHEN rn > cnt // 2 THEN x END) AS sm"
            f" FROM (SELECT CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {order_sql}) AS rn,"
            f" count(*) OVER () AS cnt FROM {table} WHERE {c} IS NOT NULL)) WHERE n >= 4")
    body = "\nUNION ALL ".join(parts)
    pct = "((sm - fm) / abs(fm) * 100)"
    r1 = S.py_round(pct, 1)
    label = f"CASE WHEN {pct} > 5 THEN 'increased' WHEN {pct} < -5 THEN 'decreased' ELSE 'remained stable' END"
    return (f"t_raw AS ({body}),\n"
            f"tr AS (SELECT position, \"column\", CAST(n AS BIGINT) AS n, round(fm, 4) AS first_mean, "
            f"round(sm, 4) AS second_mean, {r1} AS change_percent, "
            f"CASE WHEN {pct} > 5 THEN 'up' WHEN {pct} < -5 THEN 'down' ELSE 'stable' END AS direction, "
            f"\"column\" || ' ' || {label} || ' by ' || CAST(abs({r1}) AS VARCHAR) || '% across the dataset.' "
            f"AS description FROM t_raw WHERE fm IS NOT NULL AND fm <> 0)")


def _half_trend_sql(cte: str, table: str, cols: list[str], order_sql: str) -> str:
    return f"WITH {cte + ',' if cte else ''} {_half_trend_ctes(table, cols, order_sql)}\nSELECT * FROM tr"


@query("half_trend", _half_trend_sql("", "lineitem", ["l_orderkey", "l_partkey", "l_suppkey"], S.LINEITEM_ORDER_SQL))
def q_half_trend(spark, d):
    t = tl.half_trend(fx.read(spark, d, "lineitem"), order=fx.LINEITEM_ORDER)
    return t.withColumn("first_mean", r4("first_mean")).withColumn("second_mean", r4("second_mean"))


@query("half_trend_nulls", _half_trend_sql(S.ORDERS_MESSY.strip(), "om_base",
                                           ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey"))
def q_half_trend_nulls(spark, d):
    t = tl.half_trend(fx.orders_with_nulls(spark, d), order="o_orderkey")
    return t.withColumn("first_mean", r4("first_mean")).withColumn("second_mean", r4("second_mean"))


@query("derive_metrics", """
WITH t AS (SELECT l_extendedprice AS sales_amount, l_extendedprice * l_discount AS discount_cost,
                  l_quantity AS qty_units FROM lineitem),
u AS (SELECT sales_amount - discount_cost AS profit, sales_amount / CASE WHEN qty_units = 0 THEN 1 ELSE qty_units END AS avg_price,
             sales_amount FROM t)
SELECT round(sum(profit), 1) AS profit, round(avg(avg_price), 4) AS avg_price,
       round(avg(profit / CASE WHEN sales_amount = 0 THEN 1 ELSE sales_amount END), 4) AS margin FROM u""")
def q_derive_metrics(spark, d):
    li = fx.read(spark, d, "lineitem")
    t = li.select(F.col("l_extendedprice").alias("sales_amount"),
                  (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_cost"),
                  F.col("l_quantity").alias("qty_units"))
    _, k = tl.derive_metrics(t)
    return k.select(F.round("profit", 1).alias("profit"), r4("avg_price").alias("avg_price"),
                    r4("margin").alias("margin"))


# ===========================================================================
# orders
# ===========================================================================

def _kpi_sql(table: str, where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    src = f"(SELECT * FROM {table}{w})"

    def uniq(c):
        return f"CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS DOUBLE)"

    def has(c):
        return f"CASE WHEN count({c}) > 0 THEN 1 ELSE 0 END"

    rows = [
        f"SELECT 0 AS slot, 'Total Records' AS name, CAST(count(*) AS DOUBLE) AS value, 'count' AS type, "
        f"'rows' AS icon, 1 AS keep FROM {src}",
        "SELECT 1, 'Data Fields', 6.0, 'count', 'columns', 1",
        f"SELECT 2, 'Total o_orderkey', {S.py_round('sum(o_orderkey)', 2)}, 'number', 'sum', {has('o_orderkey')} FROM {src}",
        f"SELECT 3, 'Total o_custkey', {S.py_round('sum(o_custkey)', 2)}, 'number', 'sum', {has('o_custkey')} FROM {src}",
        f"SELECT 4, 'Total o_totalprice', {S.py_round('sum(o_totalprice)', 2)}, 'currency', 'dollar', "
        f"{has('o_totalprice')} FROM {src}",
        f"SELECT 5, 'Avg o_totalprice', {S.py_round('avg(o_totalprice)', 2)}, 'currency', 'trending', "
        f"{has('o_totalprice')} FROM {src}",
        f"SELECT 6, 'Unique o_orderstatus', {uniq('o_orderstatus')}, 'count', 'hash', 1 FROM {src}",
        f"SELECT 7, 'Unique o_orderpriority', {uniq('o_orderpriority')}, 'count', 'hash', 1 FROM {src}",
    ]
    body = "\nUNION ALL ".join(rows)
    return (f"WITH k AS ({body})\n"
            "SELECT CAST(row_number() OVER (ORDER BY slot) - 1 AS BIGINT) AS kpi_order, name, value, type, icon\n"
            "FROM k WHERE keep = 1 QUALIFY row_number() OVER (ORDER BY slot) <= 10")


@query("kpis", _kpi_sql("orders"))
def q_kpis(spark, d):
    return tl.kpis(fx.read(spark, d, "orders"))


@query("category_breakdown", """
SELECT CAST(row_number() OVER (ORDER BY value DESC, name) AS BIGINT) AS rank, name, value FROM (
  SELECT COALESCE(CAST(o_orderstatus AS VARCHAR), 'None') AS name, COALESCE(sum(CAST(o_orderkey AS DOUBLE)), 0.0) AS value
  FROM orders GROUP BY o_orderstatus ORDER BY value DESC, name LIMIT 8)""")
def q_category_breakdown(spark, d):
    return tl.category_breakdown(fx.read(spark, d, "orders"))


@query("category_breakdown_part", """
SELECT CAST(row_number() OVER (ORDER BY value DESC, name) AS BIGINT) AS rank, name, round(value, 2) AS value FROM (
  SELECT COALESCE(p_brand, 'None') AS name, COALESCE(sum(p_retailprice), 0.0) AS value
  FROM part GROUP BY p_brand ORDER BY round(value, 2) DESC, name LIMIT 8)""")
def q_category_breakdown_part(spark, d):
    out = tl.category_breakdown(fx.read(spark, d, "part"), "p_brand", "p_retailprice")
    return out.withColumn("value", F.round("value", 2))


@query("filter_date_range", """
SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1997-06-30 00:00:00'""")
def q_filter_date_range(spark, d):
    return tl.filter_date_range(fx.read(spark, d, "orders"), "1996-01-01", "1997-06-30")


@query("filter_date_range_events", """
SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'""")
def q_filter_date_range_events(spark, d):
    # an invalid start bound is ignored; the end bound is midnight
    return tl.filter_date_range(fx.read(spark, d, "events"), "2024-13-01", "2024-01-15")


@query("analyze_range_kpis", _kpi_sql("orders", "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30'"))
def q_analyze_range_kpis(spark, d):
    out = tl.analyze_range(fx.read(spark, d, "orders"), {}, "1996-01-01", "1997-06-30", order="o_orderkey",
                           persist=False)
    return out["kpis"]


@query("forward_fill_scan", """
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders),
m AS (SELECT o_orderkey, r, CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE o_totalprice END AS o_totalprice,
             CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM o)
SELECT o_orderkey, COALESCE(last_value(o_totalprice IGNORE NULLS) OVER w, 0) AS o_totalprice,
       last_value(o_orderstatus IGNORE NULLS) OVER w AS o_orderstatus, o_orderdate
FROM m WINDOW w AS (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_forward_fill_scan(spark, d):
    """W1 in the physical order of the file (``orders`` is stored by key), no shuffle of rows."""
    o = tl.load_table(spark, f"{d}/orders.parquet", blocks=True)
    o = o.withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 7 >= 2, F.col("o_totalprice")),
                       "o_orderstatus": F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus"))})
    filled = tl.forward_fill_scan(tl.forward_fill_scan(o, ["o_totalprice"], then=0.0), ["o_orderstatus"])
    return filled.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")


@query("row_sample_scan", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)
SELECT CAST(idx // greatest(1, n // 30) AS BIGINT) AS "index", o_orderkey, o_custkey, o_totalprice
FROM r WHERE idx % greatest(1, n // 30) = 0 AND idx // greatest(1, n // 30) < 30""")
def q_row_sample_scan(spark, d):
    return tl.row_sample_scan(tl.load_table(spark, f"{d}/orders.parquet", blocks=True))


@query("read_heads", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS position, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS rank, {c} AS value "
    f"FROM (SELECT p_partkey, {c} FROM part WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 50)" for i, c in enumerate(["p_name", "p_brand", "p_type"])))
def q_read_heads(spark, d):
    """H1 by an escalating read of files in their order (``part`` is stored by key)."""
    return tl.read_heads(tl.load_table(spark, f"{d}/part.parquet"), ["p_name", "p_brand", "p_type"], 50).rows


@query("csv_quoted_lines", """
SELECT doc_id, source, coalesce(nullif(text, ''), NULL) AS text, n_chars FROM documents""")
def q_csv_quoted_lines(spark, d):
    """``documents`` written as CSV (texts with quotes, commas and line breaks), in
    small splits, and read back split by split."""
    import uuid

    from tablelens.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablelens-csv-{uuid.uuid4().hex}.csv"
    docs = fx.read(spark, d, "documents").select("doc_id", "source", "text", "n_chars")
    docs.write.options(header=True, escape='"', emptyValue="").csv(path)
    df = tl.load_table(spark, path)
    return df.select(*tl.data_columns(df))


@query("cube_range_kpis", _kpi_sql("orders", "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30'"))
def q_cube_range_kpis(spark, d):
    """K1 of a date range from the daily cube of the table."""
    return tl.build_cube(fx.read(spark, d, "orders"), sketches=False).kpis("1996-01-01", "1997-06-30")


EVENT_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
              ("value", "double"), ("props", "string")]


def _event_range_statistics_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(EVENT_COLS):
        wide = t in ("bigint", "double")
        measures = ", ".join(f"{f} AS {name}" if wide else f"CAST(NULL AS DOUBLE) AS {name}" for f, name in (
            (f"round(avg(CAST({c} AS DOUBLE)), 4)", "mean"), (f"CAST(min({c}) AS DOUBLE)", "min"),
            (f"CAST(max({c}) AS DOUBLE)", "max"), (f"round(stddev_samp(CAST({c} AS DOUBLE)), 4)", "std")))
        parts.append(f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS null_count, "
                     f"CAST(count(DISTINCT {c}) + coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS unique_count, {measures} FROM e")
    return ("WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20')\n" + "\nUNION ALL ".join(parts))


@query("cube_range_statistics", _event_range_statistics_sql())
def q_cube_range_statistics(spark, d):
    """A3 of a date range from a cube that was built in two parts and merged; all
    distinct counts exact."""
    e = fx.read(spark, d, "events")
    names = [c for c, _ in EVENT_COLS]
    cube = tl.build_cube(e.where("event_id % 2 = 0"), exact=names, sketches=False).append(e.where("event_id % 2 = 1"))
    merged = cube.compact()
    cube.release()
    st = merged.statistics("2024-01-05", "2024-01-20")
    return st.withColumn("mean", r4("mean")).withColumn("std", r4("std"))


def _ts_sample_sql(table: str, date: str, cols: list[str], order_sql: str, points: int = 50) -> str:
    return f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {date} NULLS FIRST, {order_sql}) - 1 AS idx,
                  count(*) OVER () AS n FROM {table})
SELECT CAST(idx AS BIGINT) AS idx, {S.py_datetime(date)} AS date, {', '.join(cols)}
FROM r WHERE idx % greatest(1, n // {points}) = 0"""


@query("time_series_sample", _ts_sample_sql("orders", "o_orderdate", ["o_orderkey", "o_custkey", "o_totalprice"],
                                            "o_orderkey"))
def q_time_series_sample(spark, d):
    return tl.time_series_sample(fx.read(spark, d, "orders"), order="o_orderkey")


@query("time_series_sample_events", _ts_sample_sql("events", "ts", ["event_id", "user_id", "value"], "event_id"))
def q_time_series_sample_events(spark, d):
    return tl.time_series_sample(fx.read(spark, d, "events"), order="event_id")


@query("row_sample", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)
SELECT CAST(idx // greatest(1, n // 30) AS BIGINT) AS "index", o_orderkey, o_custkey, o_totalprice
FROM r WHERE idx % greatest(1, n // 30) = 0 AND idx // greatest(1, n // 30) < 30""")
def q_row_sample(spark, d):
    return tl.row_sample(fx.read(spark, d, "orders"), order="o_orderkey")


@query("page", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 45")
def q_page(spark, d):
    return tl.page(fx.read(spark, d, "orders"), "o_totalprice", descending=True, page_no=3, order="o_orderkey")


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def q_preview(spark, d):
    return tl.preview(fx.read(spark, d, "orders"), order="o_orderkey")


@query("head_tail", """
SELECT * FROM (SELECT *, 'first' AS part, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS rank
               FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 15))
UNION ALL
SELECT * FROM (SELECT *, 'last' AS part, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS rank
               FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5))""")
def q_head_tail(spark, d):
    return tl.head_tail(fx.read(spark, d, "orders"), order="o_orderkey")


def _search_sql(term: str) -> str:
    cells = [("o_orderkey", "CAST(o_orderkey AS VARCHAR)"), ("o_custkey", "CAST(o_custkey AS VARCHAR)"),
             ("o_orderstatus", "o_orderstatus"), ("o_totalprice", S.js_number("o_totalprice")),
             ("o_orderdate", S.py_datetime("o_orderdate")), ("o_orderpriority", "o_orderpriority")]
    cond = " OR ".join(f"COALESCE(contains(lower({e}), '{term.lower()}'), false)" for _, e in cells)
    return f"SELECT * FROM orders WHERE {cond}"


@query("search_rows", _search_sql("urgent"))
def q_search_rows(spark, d):
    return tl.search_rows(fx.read(spark, d, "orders"), "URGENT")


@query("search_rows_number", _search_sql(".25"))
def q_search_rows_number(spark, d):
    return tl.search_rows(fx.read(spark, d, "orders"), ".25")


# ===========================================================================
# customer, part, supplier
# ===========================================================================

def _domain_sql(table: str, cols: list[str], text_cols: list[str], order: str) -> str:
    names = " UNION ALL ".join(f"SELECT lower('{c}') AS piece" for c in cols)
    heads = " UNION ALL ".join(
        f"SELECT lower(v) FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {table} WHERE {c} IS NOT NULL ORDER BY {order} LIMIT 100)"
        for c in text_cols)
    kw = " UNION ALL ".join(f"SELECT {d} AS pos, '{dom}' AS domain, '{w}' AS word"
                            for d, (dom, ws) in enumerate(DOMAIN_KEYWORDS) for w in ws)
    return f"""
WITH pool AS ({names}{' UNION ALL ' + heads if heads else ''}),
kw AS ({kw}),
hit AS (SELECT DISTINCT pos, domain, word FROM kw WHERE EXISTS (SELECT 1 FROM pool WHERE contains(piece, word))),
sc AS (SELECT d.pos, d.domain, CAST(count(h.word) AS BIGINT) AS score
       FROM (SELECT DISTINCT pos, domain FROM kw) d LEFT JOIN hit h ON d.pos = h.pos GROUP BY d.pos, d.domain)"""


DOMAIN_TABLES = {
    "customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["c_name", "c_mktsegment"], "c_custkey"),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"], "p_partkey"),
    "supplier": (["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ["s_name"], "s_suppkey"),
    "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
               ["o_orderstatus", "o_orderpriority"], "o_orderkey"),
}


def _detect_sql(table: str) -> str:
    cols, text, order = DOMAIN_TABLES[table]
    return _domain_sql(table, cols, text, order) + f"""
SELECT '{table}' AS table_name,
       CASE WHEN score >= 2 THEN domain ELSE '{GENERAL_DOMAIN}' END AS business_type, score
FROM (SELECT * FROM sc ORDER BY score DESC, pos LIMIT 1)"""


@query("detect_domain", "\nUNION ALL\n".join(f"SELECT * FROM ({_detect_sql(t)})" for t in DOMAIN_TABLES))
def q_detect_domain(spark, d):
    out = None
    for t, (_, _, order) in DOMAIN_TABLES.items():
        r = tl.detect_domain(fx.read(spark, d, t), order).select(F.lit(t).alias("table_name"), "*")
        out = r if out is None else out.unionByName(r)
    return out


@query("domain_scores", _domain_sql("orders", *DOMAIN_TABLES["orders"][:2], "o_orderkey")
       + "\nSELECT CAST(pos AS BIGINT) AS position, domain, score FROM sc")
def q_domain_scores(spark, d):
    return tl.domain_scores(fx.read(spark, d, "orders"), "o_orderkey")


@query("top_value", """
SELECT 'p_brand' AS col, * FROM (SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL
                                 GROUP BY p_brand ORDER BY count DESC, value LIMIT 1)
UNION ALL
SELECT 'c_mktsegment', * FROM (SELECT c_mktsegment, count(*) FROM customer WHERE c_mktsegment IS NOT NULL
                               GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)""")
def q_top_value(spark, d):
    a = tl.top_value(fx.read(spark, d, "part"), "p_brand").select(F.lit("p_brand").alias("col"), "*")
    b = tl.top_value(fx.read(spark, d, "customer"), "c_mktsegment").select(F.lit("c_mktsegment").alias("col"), "*")
    return a.unionByName(b)


@query("n_unique", "\nUNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", "
    f"CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unique_count FROM part"
    for i, c in enumerate(["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])))
def q_n_unique(spark, d):
    return tl.n_unique(fx.read(spark, d, "part"))


@query("head_values", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS position, "
    f"CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS rank, {c} AS value "
    f"FROM (SELECT p_partkey, {c} FROM part WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 5)"
    for i, c in enumerate(["p_name", "p_brand", "p_type"])))
def q_head_values(spark, d):
    return tl.head_values(fx.read(spark, d, "part"), ["p_name", "p_brand", "p_type"], "p_partkey", 5)


# written apart from the library's patterns: what Python's float() takes, and plain decimal numbers
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
PY_FLOAT_SQL = (rf"^[-+]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][-+]?{_DIGITS})?"
                r"|(?i:inf|infinity|nan))$")
DECIMAL_SQL = r"^[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"


def _core(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[$,%]', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def _to_number(c: str) -> str:
    core = _core(c)
    return (f"(CASE WHEN regexp_matches({core}, '{DECIMAL_SQL}') AND NOT isnan(TRY_CAST({core} AS DOUBLE)) "
            f"AND NOT isinf(TRY_CAST({core} AS DOUBLE)) THEN TRY_CAST({core} AS DOUBLE) END)")


def _decision(c: str) -> str:
    core = _core("v")
    return (f"(SELECT count(*) FILTER (WHERE regexp_matches({core}, '{PY_FLOAT_SQL}') AND {core} <> '') > count(*) * 0.7 "
            f"FROM (SELECT {c} AS v FROM pm WHERE {c} IS NOT NULL ORDER BY p_partkey LIMIT 50))")


@query("coerce_numeric", f"""
WITH {S.PART_MESSY}
SELECT p_partkey,
       CASE WHEN {_decision('price_text')} THEN {_to_number('price_text')} ELSE error('price_text not converted') END AS price_text,
       CASE WHEN NOT {_decision('price_text_70')} THEN price_text_70 ELSE error('price_text_70 converted') END AS price_text_70,
       CASE WHEN {_decision('size_pct')} THEN {_to_number('size_pct')} ELSE error('size_pct not converted') END AS size_pct,
       p_name
FROM pm""")
def q_coerce_numeric(spark, d):
    return tl.coerce_numeric(fx.part_messy(spark, d), order="p_partkey")


@query("drop_duplicate_rows", """
WITH oc AS (SELECT *, 0 AS copy_no FROM orders UNION ALL SELECT *, 1 FROM orders WHERE o_orderkey % 10 = 0)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, min(copy_no) AS survivor_copy
FROM oc GROUP BY ALL""")
def q_drop_duplicate_rows(spark, d):
    out = tl.drop_duplicate_rows(fx.orders_copies(spark, d), ["o_orderkey", "_copy"])
    return out.withColumnRenamed("_copy", "survivor_copy")


CLEAN_SQL = f"""
WITH {S.ORDERS_MESSY},
filled AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         COALESCE(last_value(o_totalprice IGNORE NULLS) OVER (ORDER BY o_orderkey, copy_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS o_totalprice,
         o_orderdate, COALESCE(o_orderpriority, '(empty)') AS o_orderpriority
  FROM om),
dd AS (SELECT DISTINCT * FROM filled),
st AS (SELECT count(*) AS n, avg(o_orderkey) AS m0, stddev_samp(o_orderkey) AS s0,
              avg(o_custkey) AS m1, stddev_samp(o_custkey) AS s1, avg(o_totalprice) AS m2, stddev_samp(o_totalprice) AS s2 FROM dd),
rep AS (
  SELECT 0 AS slot, 'o_totalprice' AS "column", 'filled_numeric_nulls' AS action, count(*) FILTER (WHERE o_totalprice IS NULL) AS affected_rows FROM om
  UNION ALL SELECT 1, 'o_orderpriority', 'filled_text_nulls', count(*) FILTER (WHERE o_orderpriority IS NULL) FROM om
  UNION ALL SELECT 2, '*', 'removed_duplicates', (SELECT count(*) FROM om) - (SELECT count(*) FROM dd)
  UNION ALL SELECT 3, 'o_orderkey', 'anomalies_detected', (SELECT count(*) FROM dd, st WHERE abs(o_orderkey - m0) / s0 > 3)
  UNION ALL SELECT 4, 'o_custkey', 'anomalies_detected', (SELECT count(*) FROM dd, st WHERE abs(o_custkey - m1) / s1 > 3)
  UNION ALL SELECT 5, 'o_totalprice', 'anomalies_detected', (SELECT count(*) FROM dd, st WHERE abs(o_totalprice - m2) / s2 > 3))"""


@query("clean_report", CLEAN_SQL + """
SELECT "column", action, CAST(affected_rows AS BIGINT) AS affected_rows FROM rep WHERE affected_rows > 0""")
def q_clean_report(spark, d):
    return tl.clean_table(fx.orders_messy(spark, d), ["o_orderkey", "_copy"], persist=False).report


@query("correction_lines", CLEAN_SQL + """
SELECT "column", action, CAST(affected_rows AS BIGINT) AS affected_rows,
       "column" || ' — ' || replace(action, '_', ' ') || ' (' || CAST(affected_rows AS VARCHAR) || ' rows)' AS line
FROM rep WHERE affected_rows > 0""")
def q_correction_lines(spark, d):
    rep = tl.clean_table(fx.orders_messy(spark, d), ["o_orderkey", "_copy"], persist=False).report
    return tl.correction_lines(rep)


@query("clean_table", CLEAN_SQL + """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM dd""")
def q_clean_table(spark, d):
    c = tl.clean_table(fx.orders_messy(spark, d), ["o_orderkey", "_copy"], persist=False)
    return c.table.drop("_copy")


@query("currency_text", f"""
SELECT p_partkey, {S.rupiah('p_retailprice')} AS rupiah, {S.number_id('p_retailprice * 1000')} AS number_id,
       {S.rupiah('-p_retailprice')} AS negative
FROM part""")
def q_currency_text(spark, d):
    p = fx.read(spark, d, "part")
    return p.select("p_partkey", tx.rupiah("p_retailprice").alias("rupiah"),
                    tx.number_id(F.col("p_retailprice") * 1000).alias("number_id"),
                    tx.rupiah(-F.col("p_retailprice")).alias("negative"))


@query("table_cell_text", f"""
SELECT event_id,
       CASE WHEN kept = '' THEN {S.number_id('0')}
            WHEN regexp_matches(kept, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN {S.number_id('CAST(kept AS DOUBLE)')}
            ELSE props END AS props_cell,
       {S.rupiah('value')} AS value_cell
FROM (SELECT event_id, props, value, regexp_replace(props, '[^0-9.\\-]', '', 'g') AS kept FROM events)""")
def q_table_cell_text(spark, d):
    e = fx.read(spark, d, "events")
    return e.select("event_id", tx.table_cell_text("props", "props").alias("props_cell"),
                    tx.table_cell_text("value", "payment_value", numeric_input=True).alias("value_cell"))


@query("kpi_text", f"""
WITH {S.ANALYSES},
k AS (SELECT id, CAST(generate_subscripts(kpis, 1) - 1 AS BIGINT) AS position, unnest(kpis) AS x FROM an)
SELECT id, position, x.type AS type,
       CASE WHEN x.type = 'currency' THEN {S.rupiah('x.value')}
            WHEN x.type = 'percentage' THEN {S.number_id('x.value')} || '%'
            WHEN x.type IN ('count', 'number') THEN {S.number_id('x.value')}
            ELSE {S.js_number('x.value')} END AS text
FROM (SELECT id, position, {{'name': x.name, 'value': x.value,
        'type': CASE position WHEN 0 THEN (['currency', 'percentage', 'number', 'other'])[CAST(id AS BIGINT) % 4 + 1] ELSE x.type END}} AS x
      FROM k)""")
def q_kpi_text(spark, d):
    a = fx.analyses(spark, d)
    k = a.select("id", F.posexplode("kpis").alias("position", "x"))
    kinds = F.element_at(F.array(*[F.lit(t) for t in ["currency", "percentage", "number", "other"]]),
                         (F.col("id").cast("bigint") % 4 + 1).cast("int"))
    kind = F.when(F.col("position") == 0, kinds).otherwise(F.col("x.type"))
    return k.select("id", F.col("position").cast("bigint").alias("position"), kind.alias("type"),
                    tx.kpi_text(F.col("x.value"), kind).alias("text"))


FILE_EXTS = [".csv", ".XLSX", ".xls", ".pdf", ".docx", ".doc", ".txt", ""]


@query("file_type", f"""
SELECT doc_id, name, CASE {' '.join(f"WHEN lower(regexp_extract(name, '(\\.[^./\\\\]*)$', 1)) = '{e}' THEN '{t}'" for e, t in
                            [('.xlsx', 'excel'), ('.xls', 'excel'), ('.csv', 'csv'), ('.pdf', 'pdf'), ('.docx', 'docx'), ('.doc', 'docx')])}
                      ELSE 'unknown' END AS file_type
FROM (SELECT doc_id, source || '_' || CAST(doc_id AS VARCHAR) || (['{"', '".join(FILE_EXTS)}'])[doc_id % 8 + 1] AS name FROM documents)""")
def q_file_type(spark, d):
    doc = fx.read(spark, d, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in FILE_EXTS]), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), ext)
    return doc.select("doc_id", name.alias("name"), tx.file_type(name).alias("file_type"))


# ===========================================================================
# events as analysis records
# ===========================================================================

@query("recent", f"""
WITH {S.ANALYSES}
SELECT id, upload_id, status, created_at FROM an ORDER BY created_at DESC, id DESC LIMIT 50""")
def q_recent(spark, d):
    return tl.recent(fx.analyses(spark, d), 50).select("id", "upload_id", "status", "created_at")


@query("page_indexed", "SELECT * FROM orders ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 15 OFFSET 1200")
def q_page_indexed(spark, d):
    """A deep page from the stored order index of the table."""
    index = tl.build_order_index(fx.read(spark, d, "orders"), ["o_totalprice", "o_orderkey"])
    return index.page(80, 15)


@query("series_indexed", _ts_sample_sql("orders", "o_orderdate", ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey"))
def q_series_indexed(spark, d):
    """W3 from the order index by date."""
    index = tl.build_order_index(fx.read(spark, d, "orders"), ["o_orderdate", "o_orderkey"])
    return index.sample(50).select("idx", tx.py_datetime_text("o_orderdate").alias("date"), "o_orderkey", "o_custkey", "o_totalprice")


@query("search_indexed", _search_sql("urgent"))
def q_search_indexed(spark, d):
    """C5 through the text index of the files."""
    o = tl.load_table(spark, f"{d}/orders.parquet")
    found = tl.build_text_index(o).search(o, "URGENT")
    return found.select(*tl.data_columns(o))


@query("drop_duplicate_rows_by_hash", SQL["drop_duplicate_rows"])
def q_drop_duplicate_rows_by_hash(spark, d):
    """A1 with hashes shuffled before rows."""
    out = tl.drop_duplicate_rows_by_hash(fx.orders_copies(spark, d), ["o_orderkey", "_copy"])
    return out.withColumnRenamed("_copy", "survivor_copy")


@query("dense_distinct_counts", """
SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) AS unique_count FROM orders
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders""")
def q_dense_distinct_counts(spark, d):
    """A4 of whole-number columns by bitmaps."""
    got = dense_distinct_counts(fx.read(spark, d, "orders"), ["o_orderkey", "o_custkey"])
    return rows_frame(spark, list(got.items()), "column string, unique_count long")


def _quantiles_sql(table: str, cols: list[str], qs: list[float]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS q, round(quantile_cont(CAST({c} AS DOUBLE), {q}), 4) AS value FROM {table}"
        for c in cols for q in qs)


_QUANTILE_COLS, _QUANTILES = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"], [0.01, 0.25, 0.5, 0.75, 0.99]


@query("narrowed_quantiles", _quantiles_sql("lineitem", _QUANTILE_COLS, _QUANTILES))
def q_narrowed_quantiles(spark, d):
    """M6's exact quantiles by narrowing brackets: counts and sketches, no range shuffle."""
    got = quantiles_by_narrowing(fx.read(spark, d, "lineitem"), _QUANTILE_COLS, _QUANTILES)
    rows = [(c, q, v) for c in _QUANTILE_COLS for q, v in zip(_QUANTILES, got[c])]
    return rows_frame(spark, rows, "column string, q double, value double").withColumn("value", r4("value"))


@query("recent_offset", f"""
WITH {S.ANALYSES}
SELECT id, upload_id, status, created_at FROM an ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 75""")
def q_recent_offset(spark, d):
    return tl.recent(fx.analyses(spark, d), 25, offset=75).select("id", "upload_id", "status", "created_at")


def _report(spark, d, fmt: str) -> dict:
    """The report of ``orders``, written and read back: part name to table."""
    import uuid

    from tablelens.session import ensure_checkpoint_dir
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablelens-report-{uuid.uuid4().hex}"
    o = fx.read(spark, d, "orders")
    parts = tl.write_report({"Preview": tl.preview(o, "o_orderkey", 50), "KPIs": tl.kpis(o)}, folder, fmt)
    read = spark.read.options(header=True, escape='"').csv if fmt == "csv" else spark.read.parquet
    return {p.rsplit("/", 1)[1]: read(p) for p in parts}


@query("report_kpis_csv", _kpi_sql("orders"))
def q_report_kpis_csv(spark, d):
    """S8 as CSV: the KPI part read back."""
    k = _report(spark, d, "csv")["KPIs"]
    return k.select(F.col("kpi_order").cast("long"), "name", F.col("value").cast("double"), "type", "icon")


@query("report_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50")
def q_report_preview(spark, d):
    """S8 as Parquet: the preview part read back."""
    return _report(spark, d, "parquet")["Preview"]


@query("latest_analyses", f"""
WITH {S.ANALYSES}
SELECT upload_id, arg_max(id, (created_at, id)) AS id, max(created_at) AS created_at FROM an GROUP BY upload_id""")
def q_latest_analyses(spark, d):
    return tl.latest_analyses(fx.analyses(spark, d)).select("upload_id", "id", "created_at")


@query("dashboard", f"""
WITH {S.ANALYSES}, {S.UPLOADS.strip()}
SELECT 'total_uploads' AS metric, CAST(NULL AS VARCHAR) AS business_type, count(*) AS value FROM up
UNION ALL SELECT 'total_analyses', NULL, count(*) FROM an
UNION ALL SELECT 'business_types', NULL, count(DISTINCT business_type) FROM an
UNION ALL SELECT 'analyses_by_type', business_type, count(*) FROM an WHERE business_type IS NOT NULL GROUP BY business_type""")
def q_dashboard(spark, d):
    return tl.dashboard(fx.uploads(spark, d), fx.analyses(spark, d))["counts"]


@query("dashboard_recent", f"""
WITH {S.ANALYSES}
SELECT id, upload_id, business_type, summary, status, created_at FROM an WHERE status = 'completed'
ORDER BY created_at DESC, id DESC LIMIT 10""")
def q_dashboard_recent(spark, d):
    return tl.dashboard(fx.uploads(spark, d), fx.analyses(spark, d))["recent"]


def _explode_sql(field: str, defaults: dict[str, str]) -> str:
    cols = ", ".join(f"COALESCE(NULLIF(item.{k}, ''), '{v}') AS {k}" for k, v in defaults.items())
    return f"""
WITH {S.ANALYSES}, {S.UPLOADS.strip()},
it AS (SELECT id AS analysis_id, upload_id, CAST(generate_subscripts({field}, 1) - 1 AS BIGINT) AS position,
              unnest({field}) AS item FROM an WHERE status = 'completed')
SELECT analysis_id, position, {cols},
       COALESCE(NULLIF(up.original_name, ''), it.upload_id) AS source_label
FROM it LEFT JOIN up ON it.upload_id = up.id"""


@query("explode_insights", _explode_sql("insights", {"title": "Untitled Insight", "description": "No description available.",
                                                     "severity": "info", "category": "General"}))
def q_explode_insights(spark, d):
    return tl.explode_insights(fx.analyses(spark, d), fx.uploads(spark, d))


@query("explode_recommendations", _explode_sql("recommendations", {
    "title": "Untitled Recommendation", "description": "No description available.", "priority": "low",
    "impact": "Not specified"}))
def q_explode_recommendations(spark, d):
    return tl.explode_recommendations(fx.analyses(spark, d), fx.uploads(spark, d))


@query("reuse_answers", f"""
WITH {S.CHAT.strip()}
SELECT request_id, {S.chat_key('analysis_id', 'question')} AS key, cached_answer, cached_answer IS NOT NULL AS reused
FROM rq LEFT JOIN fresh ON {S.chat_key('analysis_id', 'question')} = fresh.key""")
def q_reuse_answers(spark, d):
    now = F.lit(fx.HISTORY_NOW).cast("timestamp_ntz")
    out = tl.reuse_answers(fx.chat_requests(spark, d), fx.chat_history(spark, d), fx.HISTORY_TTL, now)
    return out.select("request_id", "key", "cached_answer", "reused")


@query("keys_to_compute", f"""
WITH {S.CHAT.strip()}
SELECT DISTINCT {S.chat_key('analysis_id', 'question')} AS key FROM rq
WHERE {S.chat_key('analysis_id', 'question')} NOT IN (SELECT key FROM fresh)""")
def q_keys_to_compute(spark, d):
    now = F.lit(fx.HISTORY_NOW).cast("timestamp_ntz")
    return tl.keys_to_compute(fx.chat_requests(spark, d), fx.chat_history(spark, d), fx.HISTORY_TTL, now)


# ===========================================================================
# conversations
# ===========================================================================

def _lines(items: str, fmt: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: {fmt}), chr(10))"


ANSWER = f"""
CASE WHEN {S.contains_any('lower(question)', QUESTION_SUMMARY_WORDS)} THEN COALESCE(NULLIF(summary, ''), '{NO_SUMMARY}')
     WHEN {S.contains_any('lower(question)', QUESTION_KPI_WORDS)} THEN
       CASE WHEN len(kpis) > 0 THEN '{KPI_HEADER}' || chr(10) ||
            {_lines('kpis', "'  - ' || COALESCE(x.name, '') || ': ' || COALESCE(" + S.value_text('x.value', 'x.type') + ", '')")}
            ELSE '{NO_KPI}' END
     WHEN {S.contains_any('lower(question)', QUESTION_INSIGHT_WORDS)} THEN
       CASE WHEN len(insights) > 0 THEN '{INSIGHT_HEADER}' || chr(10) ||
            {_lines('insights', "'  - ' || COALESCE(x.title, '') || ': ' || COALESCE(x.description, '')")}
            ELSE '{NO_INSIGHT}' END
     WHEN {S.contains_any('lower(question)', QUESTION_RECOMMEND_WORDS)} THEN
       CASE WHEN len(recommendations) > 0 THEN '{RECOMMEND_HEADER}' || chr(10) ||
            {_lines('recommendations', "'  - [' || COALESCE(x.priority, '') || '] ' || COALESCE(x.title, '') || ': ' || COALESCE(x.description, '')")}
            ELSE '{NO_RECOMMEND}' END
     ELSE 'Analysis: ' || COALESCE(NULLIF(summary, ''), 'Completed.') || chr(10) || chr(10) || '{HELP_TAIL}' END"""


@query("answer_questions", f"""
WITH {S.ANALYSES}, {S.UPLOADS.strip()}, {S.QUESTIONS.strip()},
latest AS (SELECT upload_id, arg_max(id, (created_at, id)) AS id FROM an GROUP BY upload_id),
res AS (
  SELECT q.question_id, q.question, q.analysis_id, q.upload_id,
         CASE WHEN q.analysis_id IS NOT NULL AND q.analysis_id <> '' THEN q.analysis_id ELSE l.id END AS pick,
         q.analysis_id IS NOT NULL AND q.analysis_id <> '' AS has_aid,
         q.upload_id IS NOT NULL AND q.upload_id <> '' AS has_uid,
         EXISTS (SELECT 1 FROM up WHERE up.id = q.upload_id) AS upload_ok
  FROM qs q LEFT JOIN latest l ON q.upload_id = l.upload_id),
j AS (SELECT r.*, a.id AS a_id, a.status, a.summary, a.kpis, a.insights, a.recommendations
      FROM res r LEFT JOIN an a ON a.id = r.pick)
SELECT question_id, question, analysis_id, upload_id, a_id AS resolved_analysis_id, error,
       CASE WHEN error IS NULL THEN {ANSWER} END AS answer
FROM (SELECT *, CASE WHEN has_aid AND a_id IS NULL THEN 'Analysis not found'
                     WHEN NOT has_aid AND NOT has_uid THEN 'Analysis context is required'
                     WHEN NOT has_aid AND NOT upload_ok THEN 'Upload not found'
                     WHEN NOT has_aid AND a_id IS NULL THEN 'No analysis found for selected upload'
                     WHEN status <> 'completed' THEN 'Analysis not yet completed' END AS error FROM j)""")
def q_answer_questions(spark, d):
    return tl.answer_questions(fx.questions(spark, d), fx.analyses(spark, d), fx.uploads(spark, d))


@query("clean_question", """
SELECT conv_id, turn, CASE WHEN c = '' THEN raw ELSE c END AS question FROM (
  SELECT conv_id, turn, raw,
         regexp_replace(regexp_replace(regexp_replace(raw, '(^|\\s)@\\S+', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS c
  FROM (SELECT conv_id, turn,
               regexp_replace('@report_' || CAST(conv_id AS VARCHAR) || ' ' || text || CASE WHEN turn % 2 = 0 THEN ' @x' ELSE '' END,
                              '^\\s+|\\s+$', '', 'g') AS raw
        FROM conversations WHERE role = 'user'))""")
def q_clean_question(spark, d):
    c = fx.read(spark, d, "conversations").filter(F.col("role") == "user")
    raw = F.concat(F.lit("@report_"), F.col("conv_id").cast("string"), F.lit(" "), F.col("text"),
                   F.when(F.col("turn") % 2 == 0, F.lit(" @x")).otherwise(F.lit("")))
    return c.select("conv_id", "turn", tl.clean_question(raw).alias("question"))


# ===========================================================================
# documents, pages
# ===========================================================================

@query("text_to_rows", f"""
WITH {S.DOCS},
parts AS (SELECT doc, CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END AS l FROM dc),
parts2 AS (SELECT doc, CASE WHEN len(l) > 0 THEN l ELSE ['(empty document)'] END AS l FROM parts)
SELECT doc, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS text FROM parts2""")
def q_text_to_rows(spark, d):
    return tl.text_to_rows(fx.docs(spark, d))


@query("text_to_rows_paragraphs", f"""
WITH {S.DOCS},
parts AS (SELECT doc, list_filter(CASE WHEN text IS NULL OR text = '' THEN [] ELSE string_split(text, chr(10)) END,
                                  lambda x: regexp_replace(x, '\\s', '', 'g') <> '') AS l FROM dc),
parts2 AS (SELECT doc, CASE WHEN len(l) > 0 THEN l ELSE ['(empty document)'] END AS l FROM parts)
SELECT doc, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS text FROM parts2""")
def q_text_to_rows_paragraphs(spark, d):
    return tl.text_to_rows(fx.docs(spark, d), drop_blank=True)


@query("match_uploads", """
SELECT id, original_name, created_at FROM (SELECT CAST(page_id AS VARCHAR) AS id, url AS original_name, page_id AS created_at FROM pages)
WHERE contains(lower(original_name), 'example.org') ORDER BY created_at DESC, id DESC LIMIT 8""")
def q_match_uploads(spark, d):
    return tl.match_uploads(fx.page_uploads(spark, d), "EXAMPLE.ORG")


@query("value_format", f"""
SELECT doc_id, CASE WHEN {S.contains_any("regexp_replace(lower(text), '\\s+', '_', 'g')", CURRENCY_WORDS)}
                      OR COALESCE(list_bool_or(list_transform([source, lang],
                           lambda x: {S.contains_any("regexp_replace(lower(x), '\\s+', '_', 'g')", CURRENCY_WORDS)})), false)
                    THEN 'currency' ELSE 'number' END AS value_format
FROM documents""")
def q_value_format(spark, d):
    """Each whole document is a chart title, its source and language the series names."""
    doc = fx.read(spark, d, "documents")
    return doc.select("doc_id", tl.value_format(F.col("text"), F.array("source", "lang")).alias("value_format"))


@query("lenient_number", """
SELECT conv_id, turn,
       CASE WHEN kept = '' THEN 0.0 WHEN regexp_matches(kept, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST(kept AS DOUBLE) END AS number
FROM (SELECT conv_id, turn, regexp_replace(text, '[^0-9.\\-]', '', 'g') AS kept FROM conversations)""")
def q_lenient_number(spark, d):
    c = fx.read(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.lenient_number("text").alias("number"))


# ===========================================================================
# built from the above
# ===========================================================================

def _insights_sql() -> str:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    domain = _domain_sql("om_base", cols, ["o_orderstatus", "o_orderpriority"], "o_orderkey")
    domain = domain.replace("WITH pool", "pool", 1)
    trend = _half_trend_ctes("om_base", ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey")
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)

    def top(c):
        return f"(SELECT {c} FROM om_base WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"

    def uniq(c):
        return f"(SELECT count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM om_base)"

    def dist(slot, c):
        return (f"SELECT {slot}, '{c} Distribution', 'Found ' || {uniq(c)} || ' unique values in ''{c}''. "
                f"Most common: ''' || COALESCE({top(c)}, 'N/A') || '''. "
                f"This distribution reveals the primary segments in your business.', 'info', 'Segmentation'")

    return "\n".join([
        f"WITH {S.ORDERS_MESSY}, {domain},",
        f"dom AS (SELECT CASE WHEN score >= 2 THEN domain ELSE '{GENERAL_DOMAIN}' END AS d "
        f"FROM (SELECT * FROM sc ORDER BY score DESC, pos LIMIT 1)),",
        f"{trend},",
        f"st AS (SELECT count(*) AS n, CAST({nulls} AS DOUBLE) / (count(*) * 6) * 100 AS pct FROM om_base),",
        "rws AS (",
        "  SELECT 0 AS slot, (SELECT d FROM dom) || ' Data Analysis' AS title,",
        "         'Dataset covers ' || n || ' records with 6 data fields. 3 numeric and 2 categorical columns detected.'"
        " AS description, 'info' AS severity, 'Overview' AS category FROM st",
        "  UNION ALL",
        "  SELECT 1, CASE WHEN pct > 10 THEN 'Data Quality Issue' ELSE 'Good Data Completeness' END,",
        "         CASE WHEN pct > 10 THEN printf('%.1f', pct) || '% missing values detected. This can skew analysis "
        "results and needs attention.'",
        "              ELSE 'Only ' || printf('%.1f', pct) || '% missing values. Data quality is solid for analysis.' END,",
        "         CASE WHEN pct > 10 THEN 'warning' ELSE 'success' END, 'Data Quality' FROM st",
        "  UNION ALL " + dist(2, "o_orderstatus"),
        "  UNION ALL " + dist(3, "o_orderpriority"),
        "  UNION ALL",
        "  SELECT 4 + position, CASE WHEN direction = 'up' THEN 'Growth' ELSE 'Decline' END || ' in ' || \"column\",",
        "         \"column\" || ' changed by ' || CAST(change_percent AS VARCHAR) || '% from first to second half of data.',",
        "         CASE WHEN direction = 'up' THEN 'success' ELSE 'warning' END, 'Trend'",
        "  FROM tr WHERE direction <> 'stable')",
        "SELECT CAST(row_number() OVER (ORDER BY slot) - 1 AS BIGINT) AS position, title, description, severity, category",
        "FROM rws QUALIFY row_number() OVER (ORDER BY slot) <= 6",
    ])


@query("insights", _insights_sql())
def q_insights(spark, d):
    t = fx.orders_with_nulls(spark, d)
    dom = tl.domain_of(t, "o_orderkey")
    return tl.insights(t, dom, "o_orderkey")


@query("summary", _domain_sql("orders", *DOMAIN_TABLES["orders"][:2], "o_orderkey") + f""",
dom AS (SELECT CASE WHEN score >= 2 THEN domain ELSE '{GENERAL_DOMAIN}' END AS d FROM (SELECT * FROM sc ORDER BY score DESC, pos LIMIT 1))
SELECT 'This ' || (SELECT d FROM dom) || ' dataset contains ' || count(*) || ' records across 6 fields. '
       || 'Numeric fields: o_orderkey, o_custkey, o_totalprice. Categorical fields: o_orderstatus, o_orderpriority. '
       || 'Key financial metric: Total o_totalprice = ' || format('{{:,.2f}}', {S.py_round('sum(o_totalprice)', 2)}) || '.' AS summary
FROM orders""")
def q_summary(spark, d):
    o = fx.read(spark, d, "orders")
    dom = tl.domain_of(o, "o_orderkey")
    cc = tl.column_classes(o)
    k = [(r["name"], r["value"], r["type"]) for r in tl.kpis(o).orderBy("kpi_order").collect()]
    n = o.count()
    from tablelens.functions.frames import rows_frame
    return rows_frame(spark, [(tl.summary_text(dom, n, cc.columns, cc.numeric, cc.text, k),)], "summary string")


# ---------------------------------------------------------------------------
# rows-only checks (no SQL form)
# ---------------------------------------------------------------------------

@query("cells_to_table", """
WITH body AS (
  SELECT 0 AS _table_no, o_orderkey + 1 AS _row_no,
         CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
         o_orderstatus, CAST(o_totalprice AS VARCHAR) AS col_3,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
         CASE WHEN (o_orderkey + 1) % 50 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)
SELECT * FROM body""")
def q_cells_to_table(spark, d):
    o = fx.read(spark, d, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    parts = ", ".join(f"{i}, CAST({c} AS STRING)" for i, c in enumerate(names))
    body = o.selectExpr("o_orderkey + 1 AS row_no", f"stack({len(names)}, {parts}) AS (col_no, text)")
    # the short row: the last column of every 50th order is missing
    body = body.filter(~((F.col("row_no") % 50 == 0) & (F.col("col_no") == len(names) - 1)))
    header = o.filter(F.col("o_orderkey") == 0).selectExpr(
        "0L AS row_no", "stack(6, " + ", ".join(f"{i}, '{'' if i == 3 else c}'" for i, c in enumerate(names)) +
        ") AS (col_no, text)")
    cells = header.unionByName(body).select(F.lit("orders").alias("doc"), F.lit(0).alias("table_no"),
                                            "row_no", "col_no", "text")
    return tl.cells_to_table(cells, "orders")


def _profile_line_sql(place: int, c: str, kind: str, samples: bool = False) -> str:
    head = (f"'  {c} (type={kind}, nulls=' || count(*) FILTER (WHERE {c} IS NULL) || ', unique=' || "
            f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END || ')'")
    if kind in ("bigint", "double"):
        total = f"CAST(sum(CAST({c} AS DECIMAL(38,0))) AS VARCHAR)" if kind == "bigint" else \
            f"CAST(CAST(sum(CAST({c} AS DECIMAL(30,6))) AS DOUBLE) AS VARCHAR)"
        head += f" || ' min=' || min({c}) || ' max=' || max({c}) || ' mean=' || printf('%.2f', avg({c})) || ' sum=' || {total}"
    if samples:
        head += (f" || ' samples=[' || (SELECT string_agg(chr(39) || v || chr(39), ', ' ORDER BY k) FROM "
                 f"(SELECT {c} AS v, o_orderkey AS k FROM orders WHERE {c} IS NOT NULL ORDER BY k LIMIT 5)) || ']'")
    return f"SELECT {place}, {head} FROM orders"


@query("prompt_context", "\nUNION ALL ".join([
    "SELECT CAST(0 AS BIGINT) AS line_no, 'DATASET: ' || count(*) || ' rows, 6 columns' AS text FROM orders",
    "SELECT 1, 'COLUMNS: o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority'",
    "SELECT 2, ''", _profile_line_sql(3, "o_orderkey", "bigint"), _profile_line_sql(4, "o_custkey", "bigint"),
    _profile_line_sql(5, "o_orderstatus", "string", True), _profile_line_sql(6, "o_totalprice", "double"),
    _profile_line_sql(7, "o_orderdate", "timestamp_ntz"), _profile_line_sql(8, "o_orderpriority", "string", True),
    "SELECT 9, ''", "SELECT 10, 'FIRST 15 ROWS:'", "SELECT 26, ''", "SELECT 27, 'LAST 5 ROWS:'",
    """SELECT CASE WHEN a <= 15 THEN 10 + a ELSE 33 - z END, '{"o_orderkey": ' || o_orderkey || ', "o_custkey": ' || o_custkey ||
       ', "o_orderstatus": "' || o_orderstatus || '", "o_totalprice": ' || CAST(o_totalprice AS VARCHAR) || ', "o_orderdate": "' ||
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '", "o_orderpriority": "' || o_orderpriority || '"}'
       FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS z FROM orders)
       WHERE a <= 15 OR z <= 5"""]))
def q_prompt_context(spark, d):
    return tl.prompt_context(fx.read(spark, d, "orders"), "o_orderkey")


@query("parse_responses", """
SELECT event_id AS id,
       CASE event_id % 5 WHEN 0 THEN 'kpis' WHEN 1 THEN 'array' WHEN 2 THEN 'kpis' WHEN 3 THEN 'object' ELSE 'fallback' END AS kind,
       CAST(CASE WHEN event_id % 5 IN (0, 1, 2) THEN 1 END AS INTEGER) AS n_kpis,
       CASE WHEN event_id % 5 IN (0, 2) THEN event_type WHEN event_id % 5 = 1 THEN 'x' END AS kpi_name,
       CASE WHEN event_id % 5 IN (0, 2) THEN CAST(value AS DOUBLE) WHEN event_id % 5 = 1 THEN CAST(user_id AS DOUBLE) END
         AS kpi_value,
       CAST(NULL AS VARCHAR) AS business_type, CAST(NULL AS VARCHAR) AS summary
FROM events""")
def q_parse_responses(spark, d):
    e = fx.read(spark, d, "events")
    k = F.col("event_id") % 5
    kpi = F.concat(F.lit('{"kpis": [{"name": "'), F.col("event_type"), F.lit('", "value": '),
                   F.col("value").cast("string"), F.lit("}]}"))
    text = (F.when(k == 0, kpi)
            .when(k == 1, F.concat(F.lit('[{"name": "x", "value": '), F.col("user_id").cast("string"), F.lit("}]")))
            .when(k == 2, F.concat(F.lit("```json\n"), kpi, F.lit("\n```")))
            .when(k == 3, F.col("props"))
            .otherwise(F.concat(F.lit("no json "), F.col("event_type"))))
    out = tl.parse_responses(e.select(F.col("event_id").alias("id"), text.alias("text")))
    # flat columns: the number of KPIs read and the first one
    return out.select("id", "kind", F.when(F.col("kpis").isNotNull(), F.size("kpis")).alias("n_kpis"),
                      F.col("kpis")[0]["name"].alias("kpi_name"), F.col("kpis")[0]["value"].alias("kpi_value"),
                      "business_type", "summary")


@query("chat_context", f"""
WITH {S.ANALYSES},
a AS (SELECT *, insights[1].description AS column_stats,
             [json_object('id', id, 'status', status)::VARCHAR] AS raw_data_preview FROM an)
SELECT id, concat_ws(chr(10),
    'Business Type: ' || COALESCE(business_type, 'None'),
    'Summary: ' || COALESCE(summary, 'None'),
    CASE WHEN len(kpis) > 0 THEN chr(10) || 'KPIs:' || chr(10) || {_lines('kpis', "'  - ' || COALESCE(x.name, '') || ': ' || COALESCE(" + S.value_text('x.value', 'x.type') + ", '')")} END,
    CASE WHEN len(insights) > 0 THEN chr(10) || 'Insights:' || chr(10) || {_lines('insights', "'  - ' || COALESCE(x.title, '') || ': ' || COALESCE(x.description, '')")} END,
    CASE WHEN len(recommendations) > 0 THEN chr(10) || 'Recommendations:' || chr(10) || {_lines('recommendations', "'  - [' || COALESCE(x.priority, '') || '] ' || COALESCE(x.title, '') || ': ' || COALESCE(x.description, '')")} END,
    CASE WHEN COALESCE(length(column_stats), 0) > 0 THEN chr(10) || 'Column Statistics:' || chr(10) || substr(column_stats, 1, 3000) END,
    CASE WHEN len(raw_data_preview) > 0 THEN chr(10) || 'Sample Data (first 10 rows):' || chr(10) || {_lines('raw_data_preview[1:10]', "'  ' || x")} END
  ) AS context
FROM a""")
def q_chat_context(spark, d):
    a = fx.analyses(spark, d).withColumn("column_stats", F.col("insights")[0]["description"]) \
        .withColumn("raw_data_preview", F.array(F.to_json(F.struct("id", "status"))))
    return tl.chat_context(a)


@query("charts", """
SELECT CAST(0 AS BIGINT) AS chart_no, 'line' AS type, 'Trend over o_orderdate' AS title, 'date' AS x_key,
       'o_orderkey,o_custkey,o_totalprice' AS data_keys, CAST(NULL AS VARCHAR) AS name_key, 'currency' AS value_format
UNION ALL SELECT 1, 'bar', 'Numeric Column Summary', 'name', 'total,average', NULL, 'currency'
UNION ALL SELECT 2, 'pie', 'o_orderkey by o_orderstatus', 'name', 'value', 'name',
       CASE WHEN """ + S.contains_any("'o_orderkey_by_o_orderstatus value'", CURRENCY_WORDS) + """ THEN 'currency' ELSE 'number' END
UNION ALL SELECT 3, 'bar', 'o_orderkey Distribution', 'range', 'count', NULL, 'number'
""")
def q_charts(spark, d):
    o = fx.read(spark, d, "orders")
    idx = tl.chart_index(spark, tl.charts(o, "o_orderkey"))
    return idx.withColumn("data_keys", F.concat_ws(",", "data_keys"))


@query("recommendations", _domain_sql("orders", *DOMAIN_TABLES["orders"][:2], "o_orderkey") + f""",
dom AS (SELECT CASE WHEN score >= 2 THEN domain ELSE '{GENERAL_DOMAIN}' END AS d FROM (SELECT * FROM sc ORDER BY score DESC, pos LIMIT 1))
SELECT CAST(0 AS BIGINT) AS position, 'Upload More Data' AS title,
       'Provide larger datasets with more historical records for deeper trend analysis and more accurate forecasting.' AS description,
       'high' AS priority, 'Significantly better insights quality' AS impact
UNION ALL SELECT 1, 'Use Structured Data Files',
       'For best results, upload Excel or CSV files with clear column headers. This allows the system to calculate precise KPIs.',
       'medium', 'More accurate analysis'
UNION ALL SELECT 2, 'Regular Monitoring',
       'Upload updated ' || (SELECT d FROM dom) || ' data periodically to track changes and catch issues early.',
       'medium', 'Proactive decision-making'""")
def q_recommendations(spark, d):
    o = fx.read(spark, d, "orders")
    return tl.recommendations(spark, tl.domain_of(o, "o_orderkey"))


def _analyze_sql() -> str:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    domain = _domain_sql("dd", cols, ["o_orderstatus", "o_orderpriority"], "o_orderkey").replace("WITH pool", "pool", 1)
    trend = _half_trend_ctes("dd", ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey")
    top = "(SELECT {c} FROM dd GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    return CLEAN_SQL + f""",
{domain},
dom AS (SELECT CASE WHEN score >= 2 THEN domain ELSE '{GENERAL_DOMAIN}' END AS d
        FROM (SELECT * FROM sc ORDER BY score DESC, pos LIMIT 1)),
{trend},
ins AS (
  SELECT 0 AS slot, (SELECT d FROM dom) || ' Data Analysis' AS title
  UNION ALL SELECT 1, 'Good Data Completeness'
  UNION ALL SELECT 2, 'o_orderstatus Distribution'
  UNION ALL SELECT 3, 'o_orderpriority Distribution'
  UNION ALL SELECT 4 + position, CASE WHEN direction = 'up' THEN 'Growth' ELSE 'Decline' END || ' in ' || "column"
            FROM tr WHERE direction <> 'stable'),
ins6 AS (SELECT * FROM ins ORDER BY slot LIMIT 6),
corr AS (SELECT slot, "column" || '|' || action || '|' || CAST(affected_rows AS VARCHAR) AS line
         FROM rep WHERE affected_rows > 0)
SELECT 'orders-analysis' AS id, 'completed' AS status, (SELECT d FROM dom) AS business_type,
       'This ' || (SELECT d FROM dom) || ' dataset contains ' || (SELECT count(*) FROM dd) || ' records across 6 fields. '
         || 'Numeric fields: o_orderkey, o_custkey, o_totalprice. Categorical fields: o_orderstatus, o_orderpriority. '
         || 'Key financial metric: Total o_totalprice = '
         || format('{{:,.2f}}', {S.py_round('(SELECT sum(o_totalprice) FROM dd)', 2)}) || '.' AS summary,
       'Total Records|Data Fields|Total o_orderkey|Total o_custkey|Total o_totalprice|Avg o_totalprice|'
         || 'Unique o_orderstatus|Unique o_orderpriority' AS kpi_names,
       (SELECT string_agg(title, '|' ORDER BY slot) FROM ins6) AS insight_titles,
       (SELECT string_agg(line, ';' ORDER BY slot) FROM corr) AS corrections,
       (SELECT count(*) FROM tr) AS n_trends,
       'Most common: ''' || {top.format(c='o_orderstatus')} || '''' AS status_top,
       CAST(50 AS INTEGER) AS n_preview"""


SQL["analyze"] = _analyze_sql()


def _flat_record(rec: DataFrame) -> DataFrame:
    """The record's fields as flat columns (names and titles joined in order)."""
    return rec.select(
        "id", "status", "business_type", "summary",
        F.array_join(F.transform("kpis", lambda k: k["name"]), "|").alias("kpi_names"),
        F.array_join(F.transform("insights", lambda i: i["title"]), "|").alias("insight_titles"),
        F.array_join(F.transform("data_corrections", lambda c: F.concat_ws(
            "|", c["column"], c["action"], c["affected_rows"].cast("string"))), ";").alias("corrections"),
        F.size("trends").cast("bigint").alias("n_trends"),
        F.regexp_extract(F.col("insights")[2]["description"], r"(Most common: '[^']*')", 1).alias("status_top"),
        F.size("raw_data_preview").alias("n_preview"))


def q_analyze(spark, d):
    """B1 on the messy orders table: the stored record, flattened."""
    a = tl.analyze(fx.orders_messy(spark, d), ["o_orderkey", "_copy"])
    rec = a.record("orders-analysis", "orders")     # a local one-row table
    a.release()
    return _flat_record(rec)


Q["analyze"] = q_analyze


# ===========================================================================
# inputs that once lost rows or changed answers
# ===========================================================================

@query("clean_table_underscore", """
SELECT DISTINCT o_custkey % 20 AS "_id", o_orderstatus AS s FROM orders""")
def q_clean_table_underscore(spark, d):
    o = fx.read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("_id"), F.col("o_orderstatus").alias("s"),
                                           F.col("o_orderkey").alias("_row_id"))
    return tl.clean_table(o, persist=False).table.select("_id", "s")


_MANY_NAMES = {"a": ["key", "col_1", "key_2"], "b": ["k", "v"]}


@query("cells_to_table_many", "\nUNION ALL ".join(
    f"SELECT '{doc}' AS doc, o_orderkey // 2 % 2 AS table_no, o_orderkey + 1 AS row_no, '{name}' AS name, "
    f"{value} AS value FROM orders WHERE o_orderkey % 2 = {k}"
    for k, doc in enumerate("ab") for name, value in zip(
        _MANY_NAMES[doc], ["CAST(o_orderkey AS VARCHAR)", "o_orderstatus",
                           "CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority END"])))
def q_cells_to_table_many(spark, d):
    """Two documents with two tables each: a blank and a repeated header, short rows and cells to cut."""
    o = fx.read(spark, d, "orders")
    doc = F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b")
    body = o.select(doc.alias("doc"), (F.floor(F.col("o_orderkey") / 2) % 2).alias("table_no"),
                    (F.col("o_orderkey") + 1).alias("row_no"),
                    F.expr("stack(3, 0L, CAST(o_orderkey AS STRING), 1L, o_orderstatus, 2L, o_orderpriority) AS (col_no, text)"),
                    "o_orderkey")
    body = body.where(~((F.col("o_orderkey") % 50 == 0) & (F.col("col_no") == 2))).drop("o_orderkey")
    heads = o.where("o_orderkey = 0").selectExpr(
        "stack(5, 'a', 0L, ' key ', 'a', 1L, '  ', 'a', 2L, 'key', 'b', 0L, 'k', 'b', 1L, 'v') AS (doc, col_no, text)")
    heads = heads.select("doc", F.lit(0).cast("bigint").alias("table_no"), F.lit(0).cast("bigint").alias("row_no"),
                         "col_no", "text")
    records = tl.cells_to_records(heads.unionByName(body))
    return records.select("doc", "table_no", "row_no", F.explode("record").alias("name", "value"))


def _deep_sql(table: str, order: str, page_no: int) -> str:
    return (f"SELECT o_orderkey, price, CAST(n - {page_no * 15} AS BIGINT) AS place FROM (SELECT o_orderkey, price, "
            f"row_number() OVER (ORDER BY {order}) - 1 AS n FROM {table}) WHERE n >= {page_no * 15} AND n < {page_no * 15 + 15}")


_PRICES = "(SELECT o_orderkey, o_totalprice AS price FROM orders)"
_PRICES_NULLS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 >= 2 THEN floor(o_totalprice / 1000) END AS price FROM orders)"


def _deep(spark, d, sort, page_no, nulls=False):
    o = fx.read(spark, d, "orders")
    price = F.col("o_totalprice") if not nulls else F.when(F.col("o_orderkey") % 7 >= 2, F.floor(F.col("o_totalprice") / 1000)
                                                           .cast("double"))
    rows = tl.page(o.select("o_orderkey", price.alias("price")), sort, True, page_no, 15, "o_orderkey", top_rows=0)
    # at most 15 rows, in page order: their place is compared too
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query("page_deep_desc", _deep_sql(_PRICES, "price DESC NULLS LAST, o_orderkey", 20))
def q_page_deep_desc(spark, d):
    return _deep(spark, d, "price", 20)


@query("page_deep_key_desc", _deep_sql(_PRICES, "o_orderkey DESC", 33))
def q_page_deep_key_desc(spark, d):
    return _deep(spark, d, "o_orderkey", 33)


@query("page_deep_nulls", _deep_sql(_PRICES_NULLS, "price DESC NULLS LAST, o_orderkey", 71))
def q_page_deep_nulls(spark, d):
    """Ties in the sorted column; the page where the null cells begin (at 1,500 rows: 1,071 have a price)."""
    return _deep(spark, d, "price", 71, nulls=True)


@query("search_rows_nulls", """
SELECT o_orderkey, price, day FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 >= 2 THEN o_totalprice END AS price,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders)
WHERE contains(COALESCE(CAST(day AS VARCHAR), ''), '-n') OR contains(CAST(o_orderkey AS VARCHAR), '95')
   OR contains(COALESCE(""" + S.js_number("price") + """, ''), '95') OR contains(COALESCE(CAST(day AS VARCHAR), ''), '95')""")
def q_search_rows_nulls(spark, d):
    o = fx.read(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 >= 2, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("date")).alias("day"))
    none = tl.search_rows(o, "n").limit(1)          # nothing holds an n: null cells show no text
    return tl.search_rows(o, "95").unionByName(none)


@query("number_text", """
SELECT event_id, CAST(value / 3 AS VARCHAR) AS third, CAST(value / 1e9 AS VARCHAR) AS tiny,
       CAST(floor(value) * 1e15 AS VARCHAR) AS huge, CAST(value * 1000 AS VARCHAR) AS plain FROM events""")
def q_number_text(spark, d):
    v = F.col("value")
    return fx.read(spark, d, "events").select(
        "event_id", tx.py_repr(v / 3).alias("third"), tx.py_repr(v / 1e9).alias("tiny"),
        tx.py_repr(F.floor(v).cast("double") * 1e15).alias("huge"), tx.py_repr(v * 1000).alias("plain"))


def _chart_points_sql(table: str, numeric: list[str], text: str) -> str:
    """Summary, breakdown and histogram of a table without a date column."""
    first = numeric[0]
    bars = " UNION ALL ".join(
        f"SELECT CAST(0 AS BIGINT) AS chart_no, CAST({i} AS BIGINT) AS point, '{c}' AS x, unnest(['total', 'average']) AS series, "
        f"unnest([{S.py_round(f'sum(CAST({c} AS DOUBLE))', 2)}, {S.py_round(f'avg(CAST({c} AS DOUBLE))', 2)}]) AS value FROM {table}"
        for i, c in enumerate(numeric))
    pie = (f"SELECT 1, row_number() OVER (ORDER BY value DESC, name), name, 'value', value FROM (SELECT {text} AS name, "
           f"sum(CAST({first} AS DOUBLE)) AS value FROM {table} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)")
    bins = (f"WITH s AS (SELECT count(*) AS n, min(CAST({first} AS DOUBLE)) AS lo, max(CAST({first} AS DOUBLE)) AS hi FROM {table}), "
            f"l AS (SELECT *, least(10, greatest(3, n // 5)) AS bins FROM s), w AS (SELECT *, (hi - lo) / bins AS width FROM l) "
            f"SELECT 2, b, printf('%.0f', lo + b * width) || '-' || printf('%.0f', lo + (b + 1) * width), 'count', "
            f"CAST((SELECT count(*) FROM {table} WHERE least(floor((CAST({first} AS DOUBLE) - lo) / width), bins - 1) = b) AS DOUBLE) "
            f"FROM w, range(10) r(b) WHERE b < bins")
    return f"SELECT * FROM ({bars}) UNION ALL ({pie}) UNION ALL ({bins})"


def _tidy(points):
    """Amounts as whole hundredths, so that both engines agree on the last digit."""
    return points.withColumn("value", F.round("value", 2))


@query("charts_data", _chart_points_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], "c_mktsegment"))
def q_charts_data(spark, d):
    c = fx.read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return _tidy(tl.charts_data(spark, tl.charts(c, "c_custkey")))


_RANGE = "(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30')"


def _range_charts(spark, d):
    o = fx.read(spark, d, "orders").dropDuplicates()
    from tablelens.operators.clean import Cleaned
    return tl.analyze_range(o, {}, "1996-01-01", "1997-06-30", "o_orderkey", clean=Cleaned.of(o, "o_orderkey"))


@query("analyze_range_charts", _chart_points_sql("orders_range", ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderstatus")
       .replace("orders_range", _RANGE))
def q_analyze_range_charts(spark, d):
    """The three charts behind the time series (that one has its own query)."""
    charts = _range_charts(spark, d)["charts"]
    return _tidy(tl.charts_data(spark, charts[1:]))


@query("analyze_range_preview", f"""
SELECT o_orderkey, o_totalprice, o_orderdate FROM {_RANGE} ORDER BY o_orderkey LIMIT 50""")
def q_analyze_range_preview(spark, d):
    return _range_charts(spark, d)["raw_data_preview"].select("o_orderkey", "o_totalprice", "o_orderdate")


@query("parse_responses_full", """
SELECT event_id AS id, CASE WHEN event_id % 4 < 2 THEN 'object' ELSE 'fallback' END AS kind,
       CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '' WHEN 2 THEN 'rules ' || CAST(event_id AS VARCHAR) END AS summary,
       CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE NULL END AS n_insights,
       CASE event_id % 4 WHEN 0 THEN event_type WHEN 2 THEN 'rule' END AS insight
FROM events""")
def q_parse_responses_full(spark, d):
    """Objects with and without fields; fallbacks with and without a rule-based result."""
    e, k = fx.read(spark, d, "events"), F.col("event_id") % 4
    text = (F.when(k == 0, F.concat(F.lit('{"summary": "'), F.col("event_type"), F.lit('", "insights": [{"title": "'),
                                    F.col("event_type"), F.lit('"}]}')))
            .when(k == 1, F.lit('{"trends": []}')).otherwise(F.lit("no answer")))
    item = "array<struct<title:string,description:string,severity:string,category:string>>"
    rules = e.where(k == 2).select(
        F.col("event_id").alias("id"), F.concat(F.lit("rules "), F.col("event_id").cast("string")).alias("summary"),
        F.from_json(F.lit('[{"title": "rule"}]'), item).alias("insights"), F.array().alias("recommendations"),
        F.array().alias("trends"))
    out = tl.parse_analyses(e.select(F.col("event_id").alias("id"), text.alias("text")), rule_based=rules)
    n = F.when(F.col("insights").isNotNull(), F.size("insights"))
    return out.select("id", "kind", "summary", n.alias("n_insights"),
                      F.when(n > 0, F.col("insights")[0]["title"]).alias("insight"))


_REUSE_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _reuse_sql(prefix: str, part: str, hours: int) -> str:
    return f"""
WITH h AS (SELECT '{prefix}' || {part} AS key, 'answer ' || CAST(event_id AS VARCHAR) AS answer, ts FROM events),
fresh AS (SELECT key, arg_max(answer, struct_pack(t := ts, a := answer)) AS cached_answer FROM h
          WHERE ts <= {_REUSE_NOW} AND ts > {_REUSE_NOW} - INTERVAL {hours} HOUR GROUP BY key),
r AS (SELECT event_id AS request_id, '{prefix}' || {part} AS key FROM events)
SELECT request_id, r.key, cached_answer, cached_answer IS NOT NULL AS reused FROM r LEFT JOIN fresh ON r.key = fresh.key"""


def _reuse(spark, d, key, ttl):
    e = fx.read(spark, d, "events")
    history = e.select(key.alias("key"), F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("answer"),
                       F.col("ts").alias("created_at"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    out = tl.reuse_answers(e.withColumn("request_id", F.col("event_id")), history, ttl, now, key=key)
    return out.select("request_id", "key", "cached_answer", "reused")


@query("reuse_analyses", _reuse_sql("analysis:", "CAST(user_id AS VARCHAR)", 24))
def q_reuse_analyses(spark, d):
    """Stored analyses of an upload, for 24 hours."""
    return _reuse(spark, d, tl.analysis_key(F.col("user_id").cast("string")), 24 * 3600)


@query("reuse_prompts", _reuse_sql("prompt:", "substr(sha256(event_type || '|' || CAST(user_id AS VARCHAR)), 1, 16)", 12))
def q_reuse_prompts(spark, d):
    """Stored model answers to equal prompts, for 12 hours."""
    return _reuse(spark, d, tl.prompt_key(F.col("event_type"), F.col("user_id").cast("string")), 12 * 3600)


@query("analyze_kpis", _kpi_sql("orders", "TRUE"))
def q_analyze_kpis(spark, d):
    """KPI values of a full analysis (the table has nothing to clean)."""
    a = tl.analyze(fx.read(spark, d, "orders"), "o_orderkey", persist=False)
    return a.kpis


@query("record_charts", """
SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'line', 'Trend over o_orderdate', 'o_orderkey,o_custkey,o_totalprice', CAST(NULL AS VARCHAR)),
  (1, 'bar', 'Numeric Column Summary', 'total,average', NULL), (2, 'pie', 'o_orderkey by o_orderstatus', 'value', 'name'),
  (3, 'bar', 'o_orderkey Distribution', 'count', NULL)) t(chart_no, type, title, data_keys, name_key),
  (SELECT count(*) AS n, max(1, count(*) // 50) AS step, count(DISTINCT o_orderstatus) AS names FROM orders) o,
  LATERAL (SELECT CAST(CASE chart_no WHEN 0 THEN (n + step - 1) // step WHEN 1 THEN 3 WHEN 2 THEN least(8, names) ELSE 10 END AS INTEGER)
    AS points)""".replace("SELECT * FROM", "SELECT chart_no, type, title, data_keys, name_key, points FROM", 1).replace(
    "max(1, count(*) // 50)", "greatest(1, count(*) // 50)"))
def q_record_charts(spark, d):
    """The charts of a stored record: their parts, and how many points each holds."""
    a = tl.analyze(fx.read(spark, d, "orders"), "o_orderkey", persist=False)
    c = a.record("a", "u").select(F.posexplode("charts").alias("chart_no", "c"))
    return c.select(F.col("chart_no").cast("bigint").alias("chart_no"), "c.type", "c.title",
                    F.array_join("c.data_keys", ",").alias("data_keys"), "c.name_key", F.size("c.data").alias("points"))
