"""Quantiles by narrowing against the bucketed order and plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import quantiles as Q
from tablelens.operators.profile import exact_quantiles_many
from tests.conftest import SF_SMALL

QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("keep", [1, 50, Q.KEEP])
def test_equal_to_the_bucketed_order(spark, keep):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_orderkey"]
    want = exact_quantiles_many(li.select("*", F.monotonically_increasing_id().alias("_row_id")), cols, QS, "_row_id")
    assert Q.quantiles_by_narrowing(li, cols, QS, keep=keep) == want


@pytest.mark.parametrize("keep", [1, 100])
def test_every_position_of_odd_columns(spark, keep):
    rng = random.Random(2)
    rows = []
    for k in range(3000):
        rows.append((5.0 if k % 3 else rng.gauss(0, 1), rng.choice([None, float("nan"), -0.0, 0.0, 1.0, float("inf"), -float("inf")]),
                     rng.randrange(-2**40, 2**40) * 2**12, 1 if k < 2999 else 7, None, rng.lognormvariate(0, 6)))
    df = spark.createDataFrame(rows, "hot double, odd double, far long, `a.``b` int, none int, wide double").repartition(5)
    for k, c in enumerate(df.columns):
        plain = sorted(float(r[k]) for r in rows if r[k] is not None and r[k] == r[k])
        at = sorted({rng.randrange(3000) for _ in range(12)} | {0, 1, len(plain) - 1, 5000, -1})
        sizes, found = Q.positions_by_narrowing(df, [c], {c: at}, keep=keep)
        assert sizes == {c: len(plain)}
        assert found == {(c, p): plain[p] for p in at if 0 <= p < len(plain)}


def test_a_bad_sketch_costs_scans_only(spark, monkeypatch):
    """Marks from somewhere else in the bracket: the counts still find the value."""
    monkeypatch.setattr(Q, "_marks", lambda x: F.percentile_approx(x, [0.1 + 0.2 * k / Q._MARKS for k in range(Q._MARKS + 1)], 100))
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    sizes, found = Q.positions_by_narrowing(df, ["x"], {"x": [0, 400, 401, 990, 999]}, keep=20)
    assert found == {("x", p): float(p) for p in (0, 400, 401, 990, 999)}


def test_empty(spark):
    df = spark.range(0).select(F.col("id").alias("x"))
    assert Q.quantiles_by_narrowing(df, ["x"], [0.5]) == {"x": [None]} and Q.quantiles_by_narrowing(df, [], [0.5]) == {}


def test_no_rows_are_shuffled(spark):
    """A scan's plan: one exchange, of the partial aggregates, to one task."""
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    plan = df.agg(Q._marks(Q._number("o_totalprice")))._jdf.queryExecution().executedPlan().toString()
    assert "partial_percentile_approx" in plan and plan.count("Exchange") == 1 and "rangepartitioning" not in plan
    assert "SinglePartition" in plan and "ReadSchema: struct<o_totalprice:" in plan
