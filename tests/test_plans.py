"""Plan tests: no Python evaluation anywhere, no one-partition window over
whole tables, filters and column pruning reach the Parquet scan."""

import pytest

from checks.registry import Q as QUERIES
import tablelens as tl
from checks import fixtures as fx
from tests.conftest import SF_SMALL


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF",
                "FlatMapCoGroupsInPandas", "AggregateInPandas", "WindowInPandas",
                "Scan ExistingRDD")            # rows shipped through a Python worker


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_evaluation(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    assert not any(n in plan for n in PYTHON_NODES), plan


ROW_LEVEL = ["fill_missing", "forward_fill", "global_index", "time_series_sample", "row_sample", "clean_table",
             "text_to_rows", "search_rows", "drop_duplicate_rows", "explode_insights", "answer_questions",
             "reuse_answers", "latest_analyses", "coerce_numeric"]


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_no_single_partition_window_or_exchange(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "SinglePartition" not in plan, plan
    for line in plan.splitlines():
        if "Window [" in line:
            # every window over table rows is partitioned (by bucket, key or column)
            assert "], [], [" not in line, line


def test_date_filter_pushed_to_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    df = tl.filter_date_range(fx.read(spark, SF_SMALL, "orders"), "1996-01-01", "1997-06-30")
    plan = plan_of(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "LessThanOrEqual(o_orderdate" in plan


def test_category_breakdown_reads_two_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    df = tl.category_breakdown(fx.read(spark, SF_SMALL, "orders"))
    plan = plan_of(df)
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_dedup_is_partial_then_final_aggregate(spark):
    df = tl.drop_duplicate_rows(fx.orders_copies(spark, SF_SMALL), ["o_orderkey", "_copy"])
    plan = plan_of(df)
    assert plan.count("HashAggregate") >= 2 and "partial_min" in plan


def test_latest_is_partial_aggregate_not_window(spark):
    plan = plan_of(tl.latest_analyses(fx.analyses(spark, SF_SMALL)))
    assert "partial_max_by" in plan and "Window" not in plan
