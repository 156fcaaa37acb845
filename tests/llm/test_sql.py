"""Queries of the subpackage against their DuckDB statements, and written steps."""

import os

import pytest

from checks.compare import digest
from tablelens.llm.registry import Q, SQL
from tablelens.llm.stage import release_steps
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(k for k in SQL if k.startswith(("op11", "op12", "op13"))))
def test_matches_sql(llm_spark, duck, name):
    df = Q[name](llm_spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    other = cur.fetchall()
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, rows) == digest(columns, other)


def test_steps_are_released(llm_spark):
    release_steps(llm_spark)
    folder = llm_spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(folder))
    Q["op13_conversation_repair"](llm_spark, SF_SMALL).collect()
    assert set(os.listdir(folder)) - before
    assert release_steps(llm_spark) > 0
    assert set(os.listdir(folder)) <= before
