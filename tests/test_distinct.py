"""De-duplication by hashes first, and distinct counts by bitmaps."""

import re

import pytest
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.operators import clean, profile
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def messy(spark):
    base = spark.range(400).select((F.col("id") % 130).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("b"),
                                   F.when(F.col("id") % 11 > 0, F.col("id") % 2).alias("c"),
                                   F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("z"),
                                   F.when(F.col("id") % 5 == 0, float("nan")).otherwise(1.5).alias("f"), F.lit("t").alias("t"), "id")
    return base.withColumnRenamed("id", "_row_id").repartition(5).cache()


@pytest.mark.parametrize("case", ["hash", "collisions", "too many"])
def test_same_rows_as_whole_row_grouping(messy, case):
    options = {"hash": {}, "collisions": {"hash_of": lambda df, cols: F.col("a") % 3}, "too many": {"most": 2}}[case]
    got = tl.drop_duplicate_rows_by_hash(messy, "_row_id", **options)
    want = tl.drop_duplicate_rows(messy, "_row_id")
    rows = [sorted(str(r).replace("-0.0", "0.0") for r in df.collect()) for df in (got, want)]     # grouping drops a zero's sign
    assert got.columns == want.columns and rows[0] == rows[1]
    assert want.count() < messy.count()


def test_nulls_in_other_places_differ(spark):
    df = spark.createDataFrame([(0, 1, None), (1, None, 1), (2, None, None), (3, None, None)], "_row_id long, a long, b long")
    assert sorted(r["_row_id"] for r in tl.drop_duplicate_rows_by_hash(df).collect()) == [0, 1, 2]
    assert df.select(clean.row_hash(df, ["a", "b"])).distinct().count() == 3


def test_only_hashes_are_shuffled(spark, tmp_path):
    """Bytes shuffled: a fraction of the table where no row repeats."""
    path = str(tmp_path / "t.parquet")
    spark.range(3000).select("id", *[F.sha2(F.concat(F.col("id"), F.lit(str(k))), 256).alias(f"c{k}") for k in range(10)]).write.parquet(path)
    df = tl.load_table(spark, path)
    out = tl.drop_duplicate_rows_by_hash(df)
    assert out.count() == 3000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and tl.data_columns(out) == tl.data_columns(df)
    # the union's first branch, the rows that occur once, has no exchange of whole rows
    first = re.split(r"Aggregate\(keys?=\[id", plan.split("Union", 1)[1])[0]
    assert "hashpartitioning(id" not in first and "hashpartitioning(_row_hash" in first


def test_nested_columns(spark):
    df = spark.range(6).select(F.col("id").alias("_row_id"), F.array(F.col("id") % 2).alias("x"))
    assert tl.drop_duplicate_rows_by_hash(df).count() == 2


def test_bitmaps(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    odd = o.select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") - 700).alias("k"), (F.col("o_custkey") * 33000).alias("far"),
                   (F.col("o_orderkey") % 2 - 1).cast("byte").alias("b"), F.lit(None).cast("int").alias("none"), "o_totalprice")
    cols = ["k", "far", "b", "none"]
    want = {c: odd.select(c).where(f"{c} is not null").distinct().count() for c in cols}
    assert profile.dense_distinct_counts(odd, cols) == want
    facts = profile.table_facts(odd)
    assert {c: facts.distinct[c] for c in cols} == want
    bounds = {"k": (1200, -700, 799), "far": (1500, 0, 49_500_000), "b": (1500, -1, 0), "none": (0, None, None), "o_totalprice": (1500, 1.0, 2.0)}
    assert profile.dense_columns(odd, odd.columns, bounds) == ["k", "b"]
    assert profile.dense_distinct_counts(odd.where("false"), ["k"]) == {"k": 0} and profile.dense_distinct_counts(odd, []) == {}
