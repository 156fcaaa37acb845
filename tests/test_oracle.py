"""Every registered query against its DuckDB statement (sf0.001), and every
rows-only query runs with a stable schema."""

import pytest

import __spark_entry__ as E
from checks.compare import digest
from checks.registry import Q as QUERIES
from checks.registry import SQL
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    first = df.schema
    assert df.count() >= 0
    assert QUERIES[name](spark, SF_SMALL).schema == first


def test_every_query_has_a_doc_or_sql():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and rows[0]["name"] == "Total Records"
