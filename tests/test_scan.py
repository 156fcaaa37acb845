"""Work in the physical order of files against the ordered operators."""

import pytest
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.functions.types import order_columns
from tablelens.operators.heads import head_values
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Seven files of several row groups; the first and third hold no value of x."""
    path = str(tmp_path_factory.mktemp("scan") / "t.parquet")
    rows = spark.range(0, 7000, 1, 7).select(
        "id", F.when((F.col("id") % 1000 > 30) & ((F.col("id") / 1000).cast("int") % 2 == 1) & (F.col("id") % 5 == 0), F.col("id") * 1.5).alias("x"),
        F.when(F.col("id") % 400 == 399, F.concat(F.lit("t"), F.col("id"))).alias("t"),
        F.when(F.col("id") % 3 == 0, F.timestamp_seconds(F.col("id")).cast("timestamp_ntz")).alias("d"), F.lit("y" * 50).alias("pad"))
    rows.write.option("parquet.block.size", "4096").parquet(path)
    return path


@pytest.fixture
def many_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forward_fill(spark, folder, many_splits):
    df = tl.load_table(spark, folder, blocks=True)
    assert order_columns(df) == ["_file", "_block", "_pos"] and tl.data_columns(df) == ["id", "x", "t", "d", "pad"]
    assert df.select("_file", "_block").distinct().count() > 7
    got = tl.forward_fill_scan(df, ["x", "t", "d"])
    assert "Exchange" not in plan(got) and "Window" not in plan(got) and order_columns(got) == order_columns(df)
    want = tl.forward_fill(df, ["x", "t", "d"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    zero = tl.forward_fill_scan(df, ["x"], then=0.0)
    assert zero.where("x is null").count() == 0 and zero.where("x = 0").count() == got.where("x is null").count() > 0
    # projections, new columns and filters keep the order
    part = df.where("id % 2 = 0").withColumn("x", F.col("x") * 2).drop("pad")
    a, b = tl.forward_fill_scan(part, ["x"]), tl.forward_fill(part, ["x"])
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_positions_and_samples(spark, folder, many_splits):
    df = tl.load_table(spark, folder, blocks=True)
    got = tl.index_scan(df).select("_file", "_block", "_pos", "_idx")
    assert "Exchange" not in plan(got)
    assert [r["_idx"] for r in got.orderBy("_file", "_block", "_pos").collect()] == list(range(7000))
    for rows in (30, 7000, 9000):
        a, b = tl.row_sample_scan(df, ["id", "x"], rows), tl.row_sample(df, ["id", "x"], rows=rows)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_csv_and_json(spark, tmp_path):
    src = spark.read.parquet(f"{SF_SMALL}/orders.parquet").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 > 2, F.col("o_totalprice")))
    src.repartition(3).write.option("header", True).csv(str(tmp_path / "o.csv"))
    df = tl.load_table(spark, str(tmp_path / "o.csv"))
    a, b = tl.forward_fill_scan(df, ["o_totalprice"], then=0.0), tl.forward_fill(df, ["o_totalprice"], then=0.0)
    assert sorted(map(str, a.drop("_pos").collect())) == sorted(map(str, b.drop("_pos").collect()))


def test_shuffled_tables_are_refused(spark, folder):
    df = tl.load_table(spark, folder, blocks=True)
    with pytest.raises(Exception, match="not in physical order"):
        tl.forward_fill_scan(df.orderBy(F.col("id").desc()), ["x"]).collect()
    with pytest.raises(ValueError, match="blocks=True"):
        tl.forward_fill_scan(tl.load_table(spark, folder), ["x"])
    empty = tl.load_table(spark, folder, blocks=True).where("id < 0")
    assert tl.forward_fill_scan(empty, ["x"]).count() == 0 and tl.index_scan(empty).count() == 0


def test_escalating_read(spark, folder):
    df = tl.load_table(spark, folder)
    for cols, k, most in ((["pad"], 50, 1), (["x", "pad"], 50, 2), (["t"], 5, 4), (["t"], 50, 7)):
        read = tl.read_heads(df, cols, k)
        assert (read.files_read <= most if most < 7 else read.files_read == 7) and read.files == 7
        assert sorted(map(str, read.rows.collect())) == sorted(map(str, head_values(df, cols, None, k).collect()))
    first = tl.read_first(df, 1500)
    assert first.files_read == 2 and [r["id"] for r in first.rows.collect()] == list(range(1500))
    # the other files are not opened
    one = tl.read_first(df, 10).rows
    metric = {str(f) for r in one.select("_file").distinct().collect() for f in r}
    assert len(metric) == 1 and "file_path" in plan(one) and tl.read_first(df, 10).files_read == 1
    # a stored copy or an aggregate is read as it is
    assert tl.read_heads(df.dropDuplicates(["id"]), ["t"], 5).files == 1
