"""Stored order index and text index against the plain operators."""

import pytest
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.functions.types import order_columns
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF_SMALL}/orders.parquet")


@pytest.fixture(scope="module")
def index(orders):
    i = tl.build_order_index(orders, ["o_totalprice", "o_orderkey"], buckets=9)
    yield i
    i.release()


def test_pages_open_only_their_buckets(spark, orders, index):
    key = ["o_totalprice", "o_orderkey"]
    want = [tuple(r) for r in orders.orderBy(*key).collect()]
    assert index.n_rows == 1500 and len(index.counts) > 5
    for no, size in ((0, 15), (37, 15), (99, 15), (100, 15), (3, 400), (0, 5000)):
        assert [tuple(r) for r in index.page(no, size).collect()] == want[no * size:(no + 1) * size]
    plan = index.rows(range(750, 765))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan and "Exchange" not in plan and "Sort" not in plan
    assert len(index.buckets_of(range(750, 765))) <= 2
    got = {r["_position"]: r["o_orderkey"] for r in index.rows([0, 700, 1499, 5000, -3]).collect()}
    assert got == {p: want[p][0] for p in (0, 700, 1499)}


def test_samples(orders, index):
    a = index.sample(50).select("idx", "o_orderkey").orderBy("idx").collect()
    want = [r[0] for r in orders.orderBy("o_totalprice", "o_orderkey").select("o_orderkey").collect()]
    assert [tuple(r) for r in a] == [(p, want[p]) for p in range(0, 1500, 30)]
    assert index.sample(30, limit=3).count() == 3


def test_reopened_and_refused(spark, orders, index, tmp_path):
    again = tl.open_order_index(spark, index.path, orders)
    assert again.counts == index.counts and again.page(2, 10).collect() == index.page(2, 10).collect()
    own = str(tmp_path / "t.parquet")
    orders.limit(20).write.parquet(own)
    small = tl.build_order_index(spark.read.parquet(own), "o_orderkey")
    orders.limit(5).write.mode("append").parquet(own)
    with pytest.raises(ValueError, match="changed"):
        tl.open_order_index(spark, small.path, spark.read.parquet(own))
    with pytest.raises(ValueError, match="_position"):
        tl.build_order_index(orders.withColumn("_position", F.lit(1)), "o_orderkey")
    empty = tl.build_order_index(orders.where("false"), "o_orderkey")
    assert empty.n_rows == 0 and empty.page(0).count() == 0 and empty.sample().count() == 0


def test_text_index(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    rows = spark.range(0, 4000, 1, 8).select(
        "id", F.concat(F.lit("Größe "), (F.col("id") / 500).cast("int").cast("string"), F.lit(" Zeile")).alias("t"),
        (F.col("id") * 0.25 + 100000).alias("v"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 100).cast("int")).alias("d"),
        F.when(F.col("id") == 1234, "needle in a Haystack").alias("s"))
    rows.write.parquet(path)
    df = tl.load_table(spark, path)
    index = tl.build_text_index(df)
    files = df.select(order_columns(df)[0]).distinct().count()
    opened = {}
    for text in ("NEEDLE", "größe 3", "haystack", "100308.5", "2024-02-0", "zz", "3", "not there at all", "e 7 z"):
        want = tl.search_rows(df, text)
        got = index.search(df, text)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), text
        names = index.files(text)
        opened[text] = files if names is None else len(names)
        true = want.select(order_columns(df)[0]).distinct().count()
        assert opened[text] >= true
    assert files == 8 and opened["NEEDLE"] == 1 and opened["größe 3"] == 1 and opened["not there at all"] == 0
    assert opened["zz"] == 8 and opened["e 7 z"] == 1 and opened["100308.5"] < 8
    plan = index.search(df, "NEEDLE")._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in plan
    with pytest.raises(ValueError):
        tl.build_text_index(spark.range(3))
    assert index.release()
