"""Inputs that once lost or changed data: types of CSV columns, names that start
with an underscore, several documents, null cells, ties, skewed keys."""

import decimal
import math
import os
import random
import struct
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.functions.text import js_number_text, py_repr
from tablelens.operators import catalog
from tablelens.operators.order import GlobalOrder, forward_fill


# --- S2, S1 ----------------------------------------------------------------

def test_csv_types_look_at_every_row(spark, tmp_path):
    lines = ["n,d,b,t,s"]
    for k in range(1500):
        lines.append(f"{k if k < 1200 else f'{k}.5'},{'2024-01-01' if k < 1100 else '05/01/2024'},true,"
                     f"2024-01-02 03:04:05,x{k}")
    path = str(tmp_path / "a.csv")
    open(path, "w").write("\n".join(lines) + "\n")
    df = tl.read_csv_table(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "string", "boolean", "timestamp_ntz", "string"]
    rows = df.collect()
    assert len(rows) == 1500 and rows[1400]["n"] == 1400.5 and rows[1400]["d"] == "05/01/2024"
    assert rows[0]["t"] == datetime(2024, 1, 2, 3, 4, 5) and all(v is not None for r in rows for v in r)


def test_csv_quotes_line_breaks_and_empty_columns(spark, tmp_path):
    path = str(tmp_path / "q.csv")
    open(path, "w").write('a,b,c\n"x ""y"" z",1,\n"two\nlines",2,\n')
    df = tl.read_csv_table(spark, path, multi_line=True)
    assert [tuple(r) for r in df.collect()] == [('x "y" z', 1, None), ("two\nlines", 2, None)]
    assert df.schema["c"].dataType.simpleString() == "string"


def test_file_order_has_one_form(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"t.parquet/p{k}"))
    df = tl.with_file_order(
        spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "t.parquet")))
    assert set(df.columns) == {"id", "_file", "_pos"}
    rows = [r["id"] for r in df.orderBy("_file", "_pos").collect()]
    assert sorted(rows) == list(range(30)) and all(rows[k:k + 10] == sorted(rows[k:k + 10]) for k in (0, 10, 20))
    path = str(tmp_path / "o.csv")
    open(path, "w").write("v\n" + "\n".join(map(str, range(50))) + "\n")
    loaded = tl.load_table(spark, path)
    assert [r["v"] for r in loaded.orderBy("_file", "_block", "_pos").collect()] == list(range(50))


# --- names -----------------------------------------------------------------

def test_user_columns_named_like_the_order_are_kept(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(60).select("id", (F.col("id") * 7).alias("_pos"), F.concat(F.lit("f"), F.col("id") % 3).alias("_file"),
                           (F.col("id") % 5).alias("_row_id"), F.lit(1.5).alias("_copy")).coalesce(1).write.parquet(path)
    df = tl.load_table(spark, path)
    assert df.columns == ["id", "_pos", "_file", "_row_id", "_copy", "_file_", "_pos_"]
    assert tl.data_columns(df) == ["id", "_pos", "_file", "_row_id", "_copy"]
    rows = {r["id"]: (r["_pos"], r["_file"]) for r in df.collect()}
    assert rows == {k: (7 * k, f"f{k % 3}") for k in range(60)}
    a = tl.analyze(df)
    assert [r["column"] for r in a.column_stats.orderBy("position").collect()] == ["id", "_pos", "_file", "_row_id", "_copy"]
    assert [r["id"] for r in tl.preview(df, n=4).collect()] == [0, 1, 2, 3]
    # a stored copy keeps its marks, and is not given a second order
    again = tl.load_table(spark, a.cleaned.path + "/") if a.cleaned.path.endswith(".parquet") else tl.with_file_order(a.table)
    assert tl.data_columns(again) == tl.data_columns(df) and again.columns == a.table.columns
    a.release()
    spark.range(3).withColumnRenamed("id", "_idx").write.parquet(str(tmp_path / "w.parquet"))
    with pytest.raises(ValueError, match="_idx"):
        tl.load_table(spark, str(tmp_path / "w.parquet"))


def test_columns_that_start_with_an_underscore(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "a", 2), (3, "a", 3)], "_id long, s string, _row_id long")
    assert tl.drop_duplicate_rows(df).count() == 3
    clean = tl.clean_table(df, persist=False)
    assert clean.rows_after == 3 and "_id" in clean.table.columns
    more = df.withColumn("_pos", F.col("_row_id") * 2)
    kept = {r["_row_id"]: r["_pos"] for r in tl.drop_duplicate_rows(more, "_row_id").collect()}
    assert kept == {0: 0, 1: 2, 2: 4}


# --- S4, U1 ----------------------------------------------------------------

CELLS = [("a", 0, 0, 0, " name "), ("a", 0, 0, 1, "  "), ("a", 0, 0, 2, "name"), ("a", 0, 1, 0, " v "), ("a", 0, 1, 2, "w"),
         ("a", 0, 1, 3, "cut"), ("a", 1, 0, 0, "n1"), ("a", 1, 1, 4, "all cut"), ("b", 0, 0, 0, "x"), ("b", 0, 1, 0, "1"),
         ("b", 1, 0, 0, "2")]
CELL_SCHEMA = "doc string, table_no int, row_no int, col_no int, text string"


def test_cells_of_several_documents_stay_apart(spark):
    cells = spark.createDataFrame(CELLS, CELL_SCHEMA)
    with pytest.raises(ValueError):
        tl.cells_to_table(cells)
    got = {(r["doc"], r["table_no"], r["row_no"]): dict(r["record"]) for r in tl.cells_to_records(cells).collect()}
    assert got == {("a", 0, 1): {"name": " v ", "col_1": None, "name_2": "w"},
                   ("a", 1, 0): {"name": "n1", "col_1": None, "name_2": None},
                   ("a", 1, 1): {"name": None, "col_1": None, "name_2": None},
                   ("b", 0, 1): {"x": "1"}, ("b", 1, 0): {"x": "2"}}
    table = tl.cells_to_table(cells, "a")
    assert table.columns == ["_table_no", "_row_no", "name", "col_1", "name_2"] and table.count() == 3
    docx = tl.cells_to_table(cells, "a", docx=True).collect()
    assert [(r["name"], r["name_2"]) for r in docx] == [("v", "w")]


# --- C5, number text --------------------------------------------------------

def test_null_cells_match_nothing(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, 2.5, date(2024, 1, 2), "None here")],
                               "k long, x double, d date, s string")
    assert [r["k"] for r in tl.search_rows(df, "n").collect()] == [2]
    assert tl.search_rows(df, "none").count() == 1 and tl.search_rows(df, "2024-01").count() == 1


def test_number_text_is_exact(spark):
    random.seed(5)
    values = [1 / 3, 0.1 + 0.2, 1e16, 1e15, 1e-4, 1e-5, 5e-324, 1.7976931348623157e308, 0.0, -0.0, 1e21, 1e22, 2.0 ** 53,
              100.0, 12345678.9, -2.5e-10] + [struct.unpack("d", struct.pack("Q", random.getrandbits(64)))[0]
                                              for _ in range(500)]
    values = [v for v in values if math.isfinite(v)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", py_repr("x").alias("p"),
                                                                            js_number_text("x").alias("j")).collect()
    # the shortest text; a few doubles have two of the same length
    assert all(float(r["p"]) == r["x"] and len(r["p"]) == len(repr(r["x"])) for r in rows)
    js = {1e21: "1e+21", 1e16: "10000000000000000", 1e-5: "0.00001", -2.5e-10: "-2.5e-10", 100.0: "100",
          1 / 3: "0.3333333333333333", 0.0: "0"}
    assert all(r["j"] == js[r["x"]] for r in rows if r["x"] in js)


# --- order ------------------------------------------------------------------

def test_decimal_carries_are_exact(spark):
    value = decimal.Decimal("12345678901234567890.1234567891")
    df = spark.range(2000).withColumn("x", F.when(F.col("id") == 3, F.lit(value)).cast("decimal(38,10)"))
    go = GlobalOrder.build(df, "id", buckets=40)
    assert {r["x"] for r in forward_fill(df, ["x"], "id", go=go).where("id >= 3").select("x").collect()} == {value}


# --- scans ------------------------------------------------------------------

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan(spark):
    line = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert _plan(tl.flag_anomalies(line)).count("FileScan") == 1
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    heads = tl.head_values(part, ["p_name", "p_brand", "p_type"], "p_partkey", 5)
    assert _plan(heads).count("FileScan") == 1 and heads.count() == 15


# --- J2, J4 -----------------------------------------------------------------

def test_reuse_of_answers_prompts_and_analyses(spark):
    now = F.lit(datetime(2024, 1, 2)).cast("timestamp")
    at = datetime(2024, 1, 1, 23)
    for rows in ([("k", "a1", at), ("k", "a2", at)], [("k", "a2", at), ("k", "a1", at)]):
        history = spark.createDataFrame(rows, "key string, answer string, created_at timestamp")
        assert tl.operators.catalog.fresh_answers(history, 7200, now).first()["cached_answer"] == "a2"
    requests = spark.createDataFrame([("u1",), ("u2",), (None,)], "upload_id string")
    history = spark.createDataFrame([("analysis:u1", "x", at), ("analysis:u2", "old", datetime(2023, 1, 1))],
                                    "key string, answer string, created_at timestamp")
    got = {r["upload_id"]: r["reused"] for r in
           tl.reuse_answers(requests, history, 24 * 3600, now, key=tl.analysis_key(F.col("upload_id"))).collect()}
    assert got == {"u1": True, "u2": False, None: False}


def test_hot_and_null_keys_are_dealt_out(spark):
    left = spark.range(900).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None))
                                   .otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("2", 2)], "rk string, v long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = tl.spread_left_join(left, right, F.col("k"), "rk")
        assert "_part" in _plan(joined) and "hashpartitioning(_left_key" in _plan(joined)
        rows = joined.collect()
        assert len(rows) == 900 and sum(r["v"] == 1 for r in rows) == 300 and sum(r["v"] == 2 for r in rows) == 1
        # hot keys are found by their frequency and split in proportion; other keys are not copied
        hot = catalog.hot_keys(left, F.col("k"), rows=40)
        assert hot == {"hot": 8}
        split = tl.spread_left_join(left, right, F.col("k"), "rk", hot)
        assert sorted(map(str, split.collect())) == sorted(map(str, rows))
        spread = (left.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(8)))
                  .groupBy("k", "_part").count().where("k is null or k = 'hot'"))
        assert spread.count() == 16 and spread.agg(F.max("count")).first()[0] <= 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- B2, S7, P2 -------------------------------------------------------------

def _copies(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = folder.replace("file:", "")
    return {x for x in os.listdir(folder) if x.startswith("tablelens-")} if os.path.isdir(folder) else set()


def test_range_uses_the_kept_table_and_leaves_no_copy(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    before = _copies(spark)
    a = tl.analyze(orders, "o_orderkey")
    kept = _copies(spark)
    out = tl.analyze_range(orders, {"summary": "s"}, "1996-01-01", "1997-06-30", "o_orderkey", clean=a.cleaned)
    assert _copies(spark) == kept and out["summary"] == "s" and "cleaned" not in out
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in _plan(out["table"])
    alone = tl.analyze_range(orders, {}, "1996-01-01", "1997-06-30", "o_orderkey")
    assert sorted(map(str, alone["kpis"].collect())) == sorted(map(str, out["kpis"].collect()))
    alone["cleaned"].release()
    a.release()
    no_date = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    stored = {"summary": "s"}
    assert tl.analyze_range(no_date, stored, "1996-01-01", None, "c_custkey") is stored
    assert tl.run_analysis(orders, "a", "u", order="o_orderkey").first()["status"] == "completed"
    assert tl.run_analysis(orders, "a", "u", order="nope").first()["status"] == "failed"
    assert _copies(spark) == before


def test_record_holds_its_charts_and_marks_its_upload(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = tl.analyze(orders, "o_orderkey", persist=False)
    rec = a.record("a1", "u1")
    stored = rec.first()["charts"]
    assert [c["title"] for c in stored] == [c.title for c in a.charts] and all(c["data"] for c in stored)
    points = tl.charts_data(spark, a.charts).groupBy("chart_no").count().collect()
    assert {r["chart_no"]: r["count"] for r in points} == {
        i: len(c["data"]) * len(c["data_keys"]) for i, c in enumerate(stored)}
    uploads = spark.createDataFrame([("u1", "uploaded"), ("u2", "uploaded")], "id string, status string")
    assert {r["id"]: r["status"] for r in tl.mark_analyzed(uploads, rec.union(rec)).collect()} == {
        "u1": "analyzed", "u2": "uploaded"}


def test_full_analysis_responses(spark):
    texts = [("1", '{"summary": "s", "insights": [{"title": "t", "severity": "info"}], "trends": []}'),
             ("2", "```json\n{\"recommendations\": [{\"title\": \"r\"}]}\n```"), ("3", "no json"), ("4", "[1]"), ("5", None),
             ("6", "{broken")]
    rules = spark.createDataFrame([("3", "rule", None, None, None), ("1", "unused", None, None, None)],
                                  "id string, summary string, insights string, recommendations string, trends string")
    rules = rules.select("id", "summary", *[F.array().alias(c) for c in ("insights", "recommendations", "trends")])
    got = {r["id"]: r for r in tl.parse_analyses(spark.createDataFrame(texts, "id string, text string"),
                                                  rule_based=rules).collect()}
    assert got["1"]["kind"] == "object" and got["1"]["summary"] == "s" and got["1"]["insights"][0]["title"] == "t"
    assert got["1"]["recommendations"] == [] and got["2"]["recommendations"][0]["title"] == "r" and got["2"]["summary"] == ""
    assert got["3"]["kind"] == "fallback" and got["3"]["summary"] == "rule" and got["3"]["insights"] == []
    assert {got[k]["kind"] for k in "456"} == {"fallback"} and got["4"]["summary"] is None
