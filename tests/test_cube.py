"""Daily fact cube: ranges merged from days against the rows themselves."""

import math

import pytest
from pyspark.sql import functions as F

import tablelens as tl
from tablelens.operators.profile import table_facts
from tests.conftest import SF_SMALL

RANGES = [("2024-01-05", "2024-01-20"), ("2024-01-05", None), (None, "2024-01-12"), ("2024-01-07", "2024-01-07"),
          ("2030-01-01", "2030-02-01"), ("not a day", None), (None, None)]


@pytest.fixture(scope="module")
def events(spark):
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    # midnights, nulls in every column, and rows without a date
    at = F.when(F.col("event_id") % 9 == 0, F.date_trunc("day", "ts")).when(F.col("event_id") % 31 == 0, None).otherwise(F.col("ts"))
    return e.withColumn("ts", at.cast("timestamp_ntz")).withColumn("value", F.when(F.col("event_id") % 5 > 0, F.col("value") + 1e9)) \
        .withColumn("event_type", F.when(F.col("event_id") % 4 > 0, F.col("event_type"))).withColumn("flag", F.col("event_id") % 2 == 0) \
        .withColumn("small", (F.col("event_id") % 7).cast("short")).cache()


@pytest.fixture(scope="module")
def cube(events):
    c = tl.build_cube(events.where("user_id % 3 = 0")).append(events.where("user_id % 3 > 0"))
    yield c
    c.release()


def same(a, b):
    return a is b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("start,end", RANGES)
def test_range_facts(events, cube, start, end):
    rows = tl.filter_date_range(events, start, end)
    want = table_facts(rows)
    for c in (cube, tl.open_cube(events.sparkSession, cube.path)):
        got = c.facts(start, end)
        assert (got.rows, got.columns, got.nulls, got.count) == (want.rows, want.columns, want.nulls, want.count)
        for measure in ("sum", "mean", "min", "max", "std"):
            a, b = getattr(got, measure), getattr(want, measure)
            assert a.keys() == b.keys() and all(same(a[k], b[k]) for k in a), (measure, a, b)
        for name, n in want.distinct.items():
            assert got.distinct[name] == n if name in c.exact else abs(got.distinct[name] - n) <= 0.03 * n + 1, name
    assert [tuple(r) for r in cube.kpis(start, end).collect()] == [tuple(r) for r in tl.kpis(rows).collect()]


def test_compaction(spark, events, cube):
    merged = cube.compact()
    days = spark.read.parquet(merged.path + "/days")
    assert days.count() == days.select("day", "midnight").distinct().count() < spark.read.parquet(cube.path + "/days").count()
    a, b = merged.facts("2024-01-05", "2024-01-20"), cube.facts("2024-01-05", "2024-01-20")
    assert a.rows == b.rows and a.distinct == b.distinct and all(same(a.std[c], b.std[c]) for c in a.std)
    assert merged.release()


def test_quantiles_within_bounds(events, cube):
    for start, end in RANGES[:3]:
        values = sorted(r[0] for r in tl.filter_date_range(events, start, end).where("user_id is not null").select("user_id").collect())
        for q, v in zip((0.05, 0.5, 0.9), cube.quantiles("user_id", (0.05, 0.5, 0.9), start, end)):
            below, upto = sum(x < v for x in values), sum(x <= v for x in values)
            assert below / len(values) - 0.02 <= q <= upto / len(values) + 0.02
    assert cube.quantiles("user_id", (0.5,), "2030-01-01", None) == [None]


def test_reads_days_not_rows(spark, events, cube):
    """The plan of a range reads the stored days with the bounds pushed down."""
    plan = cube.within(spark.read.parquet(cube.path + "/days"), "2024-01-05", "2024-01-20")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day" in plan and "LessThanOrEqual(day" in plan and "Exchange" not in plan


def test_range_analysis_with_cube(events, cube):
    clean = tl.operators.clean.Cleaned.of(events, "event_id")
    plain = tl.analyze_range(events, {}, "2024-01-05", "2024-01-20", order="event_id", clean=clean)
    fast = tl.analyze_range(events, {}, "2024-01-05", "2024-01-20", order="event_id", clean=clean, cube=cube)
    assert [tuple(r) for r in plain["kpis"].collect()] == [tuple(r) for r in fast["kpis"].collect()]
    assert [c.title for c in plain["charts"]] == [c.title for c in fast["charts"]]


def test_dates_and_tables_without(spark):
    days = spark.sql("select date'2024-01-01' + cast(id % 4 as int) as d, cast(id as double) as v, 'x' as t from range(20)")
    cube = tl.build_cube(days)
    assert cube.facts("2024-01-02", "2024-01-03").sum["v"] == sum(i for i in range(20) if i % 4 in (1, 2))
    assert cube.release()
    empty = tl.build_cube(days.where("false"))
    assert empty.facts().rows == 0 and empty.kpis().count() == 3
    assert empty.release()
    with pytest.raises(ValueError):
        tl.build_cube(days.select("v", "t"))
