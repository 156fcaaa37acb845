"""Plain-Python oracles for the edge cases of the analysed application
(SURVEY §5 traps), on small tables."""

import math

import pytest
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.operators.clean import numeric_decisions
from tablelens.operators.kpi import kpi_rows


def py_float_ok(v: str) -> bool:
    cleaned = str(v).replace(",", "").replace("$", "").replace("%", "").strip()
    try:
        if cleaned:
            float(cleaned)
            return True
    except ValueError:
        pass
    return False


def test_float_grammar_matches_python(spark):
    samples = ["1", " 2.5 ", "$1,234.50", "45%", "", "$", "1d", "1f", "1_000", "nan", "NaN", "inf", "-Infinity",
               "1e5", "1E-3", ".5", "5.", "+3", "--3", "1__0", "_1", "1_", "0x10", "1.2.3", "abc", "1 2"]
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    got = {r["v"]: r["ok"] for r in df.select("v", tl.functions.text.parses_as_python_float("v").alias("ok")).collect()}
    assert got == {s: py_float_ok(s) for s in samples}


def test_conversion_values(spark):
    df = spark.createDataFrame([(s,) for s in ["$1,234.50", "45%", "1_000", "nan", "1d", "", "n/a", "-7"]], "v string")
    got = [r[0] for r in df.select(tl.functions.text.to_number("v")).collect()]
    assert got == [1234.5, 45.0, None, None, None, None, None, -7.0]


def _messy(spark, bad_every):
    rows = [(i, "n/a" if bad_every(i) else f"${i},000.25") for i in range(60)]
    return spark.createDataFrame(rows, "_row_id long, price string")


def test_c1_threshold_is_strict(spark):
    # 35 of the first 50 parse (70 %): not converted
    d = numeric_decisions(_messy(spark, lambda i: i % 10 < 3))
    assert d["price"] == (50, 35, False)
    # 37 of 50 (74 %): converted
    df = tl.coerce_numeric(_messy(spark, lambda i: i % 4 == 0))
    assert dict(df.dtypes)["price"] == "double"


def test_c1_all_null_column_skipped(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "_row_id long, t string")
    assert numeric_decisions(df) == {}


def test_fill_missing_leading_nulls_and_text(spark):
    df = spark.createDataFrame([(0, None, None, None), (1, 2.0, "a", None), (2, None, None, True)],
                               "_row_id long, x double, t string, b boolean")
    out, rep = tl.fill_missing(df)
    rows = sorted(out.collect())
    assert [r["x"] for r in rows] == [0.0, 2.0, 2.0]
    assert [r["t"] for r in rows] == ["(empty)", "a", "(empty)"]
    assert [r["b"] for r in rows] == [None, None, True]   # other types untouched
    assert rep == [("x", "filled_numeric_nulls", 2), ("t", "filled_text_nulls", 2)]


def test_duplicates_after_fill(spark):
    # rows that differ only by a value filled earlier become duplicates
    df = spark.createDataFrame([(0, 1.0, "a"), (1, None, "a"), (2, 1.0, "a")], "_row_id long, x double, t string")
    c = tl.clean_table(df, persist=False)
    assert c.rows_after == 1
    assert c.table.collect()[0]["_row_id"] == 0
    lines = {(r["column"], r["action"]): r["affected_rows"] for r in c.report.collect()}
    assert lines[("*", "removed_duplicates")] == 2


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    h = sorted(tl.histogram(df, "x").collect())
    assert len(h) == 3                                # 11 // 5 = 2 → at least 3 bins
    assert sum(r["count"] for r in h) == 11
    assert h[-1]["count"] == 4                        # the maximum is in the last bin
    const = spark.createDataFrame([(5.0,)] * 9, "x double")
    hc = sorted(tl.histogram(const, "x").collect())
    assert [r["count"] for r in hc] == [9, 0, 0] and hc[0]["range"] == "5-6"
    one = spark.createDataFrame([(5.0,)], "x double")
    assert tl.histogram(one, "x").count() == 0


def test_half_trend_first_mean_zero(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 5.0), (3, 9.0)], "_row_id long, x double")
    assert tl.half_trend(df, ["x"]).count() == 0
    df2 = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 2, 2])], "_row_id long, x double")
    r = tl.half_trend(df2, ["x"]).first()
    assert (r["direction"], r["change_percent"]) == ("up", 66.7)


def test_kpi_cap_and_money_words(spark):
    cols = ", ".join(f"revenue_{i} double" for i in range(5)) + ", name string, kind string"
    df = spark.createDataFrame([tuple([1.0] * 5 + ["a", "b"])], cols)
    rows = kpi_rows(df)
    assert len(rows) == 10
    assert [r[0] for r in rows][:4] == ["Total Records", "Data Fields", "Total revenue_0", "Avg revenue_0"]
    assert all(r[2] == "currency" for r in rows[2:])


def test_top_value_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "t string")
    assert tl.top_value(df, "t").first()["value"] == "a"


def test_unique_counts_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "t string")
    assert tl.n_unique(df).first()["unique_count"] == 2


def test_one_row_std_is_null(spark):
    df = spark.createDataFrame([(1.5,)], "x double")
    assert tl.column_statistics(df).first()["std"] is None


def test_date_filter_end_is_midnight(spark):
    df = spark.createDataFrame([("2024-01-15 00:00:00",), ("2024-01-15 10:00:00",), ("2024-01-14 23:00:00",)],
                               "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))
    assert tl.filter_date_range(df, None, "2024-01-15").count() == 2
    assert tl.filter_date_range(df, "bad", None).count() == 3


def test_domain_ties_and_threshold(spark):
    one = spark.createDataFrame([(0, 1)], "_row_id long, price long")
    assert tl.domain_of(one) == "General Business"          # one keyword only
    two = spark.createDataFrame([(0, "menu", "x")], "_row_id long, sku string, other string")
    # 'sku' (retail) and 'menu' (food) each score 1 -> General Business
    assert tl.domain_of(two) == "General Business"
    tie = spark.createDataFrame([(0, "menu cafe")], "_row_id long, sku_price string")
    # retail: sku, price (2); food: menu, cafe (2) → first listed wins
    assert tl.domain_of(tie) == "Retail / E-commerce"


def test_text_to_rows(spark):
    docs = spark.createDataFrame([("a", "x\n\ny\n"), ("b", ""), ("c", "  \n ")], "doc string, text string")
    got = [(r["doc"], r["line_no"], r["text"]) for r in tl.text_to_rows(docs).orderBy("doc", "line_no").collect()]
    assert got == [("a", 0, "x"), ("a", 1, ""), ("a", 2, "y"), ("a", 3, ""), ("b", 0, "(empty document)"),
                   ("c", 0, "  "), ("c", 1, " ")]
    kept = [(r["doc"], r["text"]) for r in tl.text_to_rows(docs, drop_blank=True).orderBy("doc", "line_no").collect()]
    assert kept == [("a", "x"), ("a", "y"), ("b", "(empty document)"), ("c", "(empty document)")]


def test_cells_to_table(spark):
    cells = [("d", 0, 0, 0, " name "), ("d", 0, 0, 1, ""), ("d", 0, 1, 0, "a"), ("d", 0, 1, 1, "1"),
             ("d", 0, 2, 0, "b"), ("d", 1, 0, 0, "c"), ("d", 1, 0, 1, "3"), ("d", 1, 0, 2, "extra")]
    df = spark.createDataFrame(cells, "doc string, table_no int, row_no int, col_no int, text string")
    t = tl.cells_to_table(df, "d")
    assert [c for c in t.columns if not c.startswith("_")] == ["name", "col_1"]
    rows = [(r["name"], r["col_1"]) for r in t.orderBy("_table_no", "_row_no").collect()]
    assert rows == [("a", "1"), ("b", None), ("c", "3")]


def test_clean_question(spark):
    df = spark.createDataFrame([("@file_a  what   is @b total ",), ("@only",), ("  plain  ",)], "q string")
    got = [r[0] for r in df.select(tl.clean_question("q")).collect()]
    assert got == ["what is total", "@only", "plain"]


def test_number_text_like_python(spark):
    vals = [2.675, 6.175, 0.25, -0.4, 12345678.9, 1e7, 15000.0, 0.125]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    t = tl.functions.text
    got = df.select(t.fixed("x", 2).alias("f2"), t.fixed("x", 0).alias("f0"), t.py_round("x", 1).alias("r1"),
                    t.py_repr("x").alias("s")).collect()
    for v, r in zip(vals, got):
        assert r["f2"] == f"{v:.2f}" and r["f0"] == f"{v:.0f}" and r["r1"] == round(v, 1) and r["s"] == str(v)


def test_rupiah(spark):
    df = spark.createDataFrame([(1234567.5,), (-2.5,), (0.4,)], "x double")
    got = [r[0] for r in df.select(tl.functions.text.rupiah("x")).collect()]
    assert got == ["Rp 1.234.568", "-Rp 3", "Rp 0"]


def test_lenient_number(spark):
    df = spark.createDataFrame([("abc",), ("2024-01-05",), ("Rp 1.500",), ("-3.5 kg",), (None,)], "v string")
    got = [r[0] for r in df.select(tl.functions.text.lenient_number("v")).collect()]
    assert got == [0.0, None, 1.5, -3.5, None]


def test_answers_rules(spark):
    kp = "array<struct<name:string,value:double,type:string,icon:string,description:string>>"
    an = spark.createDataFrame(
        [("a1", "u1", "completed", "Retail", "S", [("Total Records", 15.0, "count", "rows", None),
                                                   ("Avg x", 2.5, "currency", "trending", None)], [], [],
          "2024-01-01 00:00:00"),
         ("a2", "u1", "failed", None, "", None, None, None, "2024-01-02 00:00:00")],
        f"id string, upload_id string, status string, business_type string, summary string, kpis {kp}, "
        "insights array<struct<title:string,description:string,severity:string,category:string>>, "
        "recommendations array<struct<title:string,description:string,priority:string,impact:string>>, "
        "created_at string")
    qs = spark.createDataFrame([(1, "Show the KPI", "a1", None), (2, "hello", None, "u1"), (3, "x", None, None),
                                (4, "any insight", "a1", None), (5, "tell me", "zz", None)],
                               "question_id int, question string, analysis_id string, upload_id string")
    got = {r["question_id"]: (r["error"], r["answer"]) for r in tl.answer_questions(qs, an).collect()}
    assert got[1] == (None, "Here are the key metrics:\n  - Total Records: 15\n  - Avg x: 2.5")
    assert got[2] == ("Analysis not yet completed", None)
    assert got[3] == ("Analysis context is required", None)
    assert got[4] == (None, "No insights available.")
    assert got[5] == ("Analysis not found", None)


@pytest.mark.parametrize("name,kind", [("revenue", "sales"), ("Stock", "inventory"), ("x", "unknown")])
def test_detect_kind(name, kind):
    assert tl.detect_kind([name]) == kind


def test_map_metrics_later_group_wins():
    assert tl.map_metrics(["sales_qty", "biaya", "laba"]) == {"sales_qty": "quantity", "biaya": "cost",
                                                              "laba": "profit"}


def test_exact_quantiles(spark):
    import statistics
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "_row_id long, x double")
    got = tl.exact_quantiles(df, "x", [0.25, 0.5, 0.75])
    want = statistics.quantiles(vals, n=4, method="inclusive")
    assert all(math.isclose(a, b) for a, b in zip(got, want))


def test_load_table_parquet_row_order(spark):
    df = tl.load_table(spark, "/root/testdata/sf0.001/orders.parquet")
    assert {"_file", "_pos"} <= set(df.columns) and "_file" not in tl.data_columns(df)
    assert df.select("_file", "_pos").distinct().count() == df.count()


def test_csv_inference_and_suffix_dispatch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").orderBy("o_orderkey")
    out = str(tmp_path / "orders.csv")
    src.coalesce(1).write.option("header", True).csv(out)
    df = tl.load_table(spark, out)
    types = dict(df.dtypes)
    assert types["o_orderkey"] == "bigint" and types["o_totalprice"] == "double"
    assert types["o_orderdate"] == "timestamp_ntz" and types["o_orderstatus"] == "string"
    assert df.count() == src.count()
    with pytest.raises(ValueError):
        tl.load_table(spark, str(tmp_path / "x.txt"))


def test_file_manifest_labels(spark, tmp_path):
    for name in ["a.CSV", "b.xlsx", "c.doc", "d.txt"]:
        (tmp_path / name).write_text("x")
    m = {r["original_name"]: (r["file_type"], r["allowed"], r["status"], r["client_accepts"])
         for r in tl.file_manifest(spark, str(tmp_path)).collect()}
    assert m == {"a.CSV": ("csv", True, "uploaded", True), "b.xlsx": ("excel", True, "uploaded", True),
                 "c.doc": ("docx", True, "uploaded", False), "d.txt": ("unknown", False, "rejected", False)}


@pytest.mark.parametrize("sort", [None, "k", "v", "u"])
@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_equal_shallow_ones(spark, sort, descending):
    """Nulls, ties and the order key, in both directions; rows compared in order."""
    df = spark.range(900).select(
        F.col("id").alias("k"), F.when(F.col("id") % 11 != 0, F.col("id") * 37 % 20).alias("v"),
        F.when(F.col("id") % 5 != 0, (F.col("id") * 7919 % 900) / 7).alias("u"))
    for page_no in (0, 23, 59, 60):
        shallow = tl.page(df, sort, descending, page_no, 15, "k").collect()
        assert tl.page(df, sort, descending, page_no, 15, "k", top_rows=0).collect() == shallow


def test_analyze_record(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = tl.analyze(o, "o_orderkey")
    assert a.business_type == "Retail / E-commerce"
    rec = a.record("x", "u").first()
    assert rec["status"] == "completed" and len(rec["raw_data_preview"]) == 50
    assert rec["kpis"][0]["name"] == "Total Records"
    assert {c.type for c in a.charts} == {"line", "bar", "pie"}


def test_records_append_and_current_state(spark, tmp_path):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = tl.analyze(o, "o_orderkey", persist=False)
    path = str(tmp_path / "analyses")
    rec = a.record("a1", "u1")
    tl.write_analysis(rec.withColumn("status", F.lit("processing")).withColumn("completed_at", F.lit(None)), path)
    tl.write_analysis(rec, path)
    stored = tl.read_analyses(spark, path)
    assert stored.count() == 2
    cur = tl.current_analyses(stored).collect()
    assert len(cur) == 1 and cur[0]["status"] == "completed"
    q = spark.createDataFrame([(1, "tell me a summary", "a1", None)],
                              "question_id int, question string, analysis_id string, upload_id string")
    ans = tl.answer_questions(q, tl.current_analyses(stored)).first()["answer"]
    assert ans.startswith("This Retail / E-commerce dataset contains 1500 records")


def test_write_report(spark, tmp_path):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = tl.analyze(o, "o_orderkey", persist=False)
    parts = {"Preview": a.preview, "Stats": a.column_stats, "KPIs": a.kpis, "Insights": a.insights}
    written = tl.write_report(parts, str(tmp_path / "report"))
    assert [w.rsplit("/", 1)[1] for w in written] == ["Preview", "Stats", "KPIs", "Insights"]
    back = spark.read.option("header", True).csv(written[2])
    assert back.count() == a.kpis.count()


@pytest.mark.parametrize("n", [0, 1, 9])
def test_analyze_small_and_empty_tables(spark, n):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").orderBy("o_orderkey").limit(n)
    o = spark.createDataFrame(o.collect(), o.schema)
    a = tl.analyze(o, "o_orderkey", persist=False)
    rec = a.record("x", "u").first()
    kp = {k["name"]: k["value"] for k in rec["kpis"]}
    assert kp["Total Records"] == n and kp["Data Fields"] == 6
    if n == 0:
        assert "Total o_totalprice" not in kp                      # numeric KPIs absent
        assert all(c.data.count() == 0 for c in a.charts if c.type == "bar" and c.x_key == "range")
    if n == 1:
        assert a.column_stats.filter("column = 'o_totalprice'").first()["std"] is None
    assert len(rec["raw_data_preview"]) == n


def test_range_with_no_rows(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = tl.analyze_range(o, {"summary": "kept"}, "2100-01-01", None, order="o_orderkey", persist=False)
    kp = {r["name"]: r["value"] for r in out["kpis"].collect()}
    assert kp == {"Total Records": 0.0, "Data Fields": 6.0, "Unique o_orderstatus": 0.0,
                  "Unique o_orderpriority": 0.0}
    assert out["summary"] == "kept"
    assert tl.analyze_range(o, {"summary": "kept"}, None, None, order="o_orderkey") == {"summary": "kept"}


def test_constant_column_histogram_and_anomalies(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(12)], "_row_id long, x double")
    assert tl.anomaly_report(df).count() == 0                      # zero deviation: skipped
    h = sorted(tl.histogram(df, "x").collect())
    assert [r["count"] for r in h] == [12, 0, 0] and [r["range"] for r in h] == ["5-6", "6-7", "7-8"]


def test_recent_offset(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(10)], "id string, created_at long")
    assert [r["id"] for r in tl.recent(df, 3, offset=2).collect()] == ["7", "6", "5"]


def test_release_deletes_cleaned_copy(spark):
    import os
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    c = tl.clean_table(o, "o_orderkey", persist=True)
    path = c.path.replace("file:", "")
    assert c.table.count() == 1500 and os.path.isdir(path)
    assert c.release() and not os.path.exists(path)


def test_csv_file_order_and_analysis(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").orderBy("o_orderkey")
    out = str(tmp_path / "orders_csv")
    src.repartition(1).sortWithinPartitions("o_orderkey").write.option("header", True).csv(out + "/a.csv")
    df = tl.load_table(spark, out + "/a.csv")
    assert {"_file", "_block", "_pos"} <= set(df.columns)
    first = tl.preview(df, n=5).select("o_orderkey").collect()
    assert [r[0] for r in first] == [0, 1, 2, 3, 4]
    a = tl.analyze(df, persist=False)
    assert a.business_type == "Retail / E-commerce"
    assert {k["name"] for k in a.kpis.collect()} >= {"Total Records", "Total o_totalprice"}


def test_exact_quantiles_many_columns(spark):
    import statistics
    rows = [(i, float((i * 37) % 101), None if i % 4 == 0 else float((i * 11) % 13), float(i % 2)) for i in range(57)]
    df = spark.createDataFrame(rows, "_row_id long, a double, b double, c double")
    got = tl.operators.profile.exact_quantiles_many(df, ["a", "b", "c"], [0.25, 0.5, 0.75])
    for j, col in enumerate(["a", "b", "c"]):
        vals = [r[j + 1] for r in rows if r[j + 1] is not None]
        want = statistics.quantiles(vals, n=4, method="inclusive")
        assert all(math.isclose(x, y) for x, y in zip(got[col], want)), col


def test_run_analysis_lifecycle(spark, tmp_path):
    path = str(tmp_path / "records")
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    ok = tl.run_analysis(o, "a1", "u1", path, order="o_orderkey").first()
    assert ok["status"] == "completed"
    bad = tl.run_analysis(o, "a2", "u2", path, order="no_such_column").first()
    assert bad["status"] == "failed" and bad["summary"].startswith("Analysis failed: ")
    stored = tl.read_analyses(spark, path)
    assert sorted(r["status"] for r in stored.collect()) == ["completed", "failed", "processing", "processing"]
    cur = {r["id"]: r["status"] for r in tl.current_analyses(stored).collect()}
    assert cur == {"a1": "completed", "a2": "failed"}


def test_cells_one_row_table_prints_like_python(spark):
    vals = ["a", None, "it's", 'say "hi"', "both ' \"", "back\\slash", "new\nline"]
    cells = spark.createDataFrame([("d", 0, 0, i, v) for i, v in enumerate(vals)],
                                  "doc string, table_no int, row_no int, col_no int, text string")
    assert tl.cells_to_table(cells, "d").collect()[0]["text"] == repr(vals)


def test_answer_keys(spark):
    import hashlib
    df = spark.createDataFrame([("a1", "  What IS this? ", "sys", "user text")], "aid string, q string, s string, u string")
    r = df.select(tl.question_key(F.col("aid"), F.col("q")).alias("k"), tl.prompt_key(F.col("s"), F.col("u")).alias("p")).first()
    assert r["k"] == "chat:a1:" + hashlib.sha256("what is this?".encode()).hexdigest()[:16]
    assert r["p"] == "prompt:" + hashlib.sha256("sys|user text".encode()).hexdigest()[:16]
    from tablelens.functions import words
    assert (words.TTL_ANALYSIS, words.TTL_QUESTION, words.TTL_PROMPT, words.TTL_DASHBOARD) == (86400, 14400, 43200, 300)


def test_type_classes_in_analysis(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    df = o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 9 == 0, None).otherwise((F.col("o_custkey") % 100)).cast("short").alias("small"),
        (F.col("o_orderstatus") == "F").alias("flag"),
        F.col("o_orderdate").cast("date").alias("day"),
        "o_totalprice")
    a = tl.analyze(df, "o_orderkey", persist=False)
    names = [r["name"] for r in a.kpis.collect()]
    assert "Total small" not in names and "Total o_totalprice" in names      # short: no KPI
    stats = {r["column"]: r for r in a.column_stats.collect()}
    assert stats["small"]["null_count"] == 0 and stats["small"]["mean"] is not None   # filled and profiled
    lines = {(r["column"], r["action"]) for r in a.cleaned.report.collect()}
    assert ("small", "filled_numeric_nulls") in lines
    ts = [c for c in a.charts if c.type == "line"][0]
    assert ts.title == "Trend over day" and len(ts.data.first()["date"]) == 10       # date text
    assert "small" not in ts.data_keys


def test_converted_values_are_then_filled(spark):
    from checks import fixtures as fx
    pm = fx.part_messy(spark, "/root/testdata/sf0.001")
    n_bad = pm.filter(F.col("price_text") == "n/a").count()
    c = tl.clean_table(pm, "p_partkey", persist=False)
    types = dict(c.table.dtypes)
    assert types["price_text"] == "double" and types["price_text_70"] == "string" and types["size_pct"] == "double"
    assert c.table.filter(F.col("price_text").isNull()).count() == 0
    lines = {(r["column"], r["action"]): r["affected_rows"] for r in c.report.collect()}
    assert lines[("price_text", "filled_numeric_nulls")] == n_bad
    assert not any(a == "converted_to_numeric" for _, a in lines)      # that line never appears
