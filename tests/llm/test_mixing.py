"""Mixing sources against a plain version in exact arithmetic."""

from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from tablelens.llm import mixing as M
from tests.llm.conftest import words


def plain_targets(sizes, weights, share, most):
    """Each source's target: share by weight, the excess of full ones reshared."""
    total, full = Fraction(share) * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        shared = sum(weights[s] for s in sizes if s not in full)
        level = {s: rest * weights[s] / shared if shared else 0 for s in sizes if s not in full}
        over = {s for s, t in level.items() if t > most * sizes[s]}
        if not over:
            return {**{s: Fraction(most * sizes[s]) for s in full}, **level}
        full |= over


def ranked(sources, weights=(3, 1, 2)):
    order = sorted(s for s in sources if s is not None) + [s for s in sources if s is None]
    return {s: weights[i % len(weights)] for i, s in enumerate(order)}


@pytest.fixture(scope="module")
def mixed_docs(llm_spark, edge):
    source = F.when(F.col("key") % 5 == 0, None).when(F.col("key") % 5 == 1, "").otherwise(F.concat(F.lit("ä"), F.col("key") % 5))
    return edge.withColumn("source", source).withColumn("size", F.lit("clash")).withColumn("s", F.lit(1))


def check(rows, share=Fraction(3, 2), most=2, weights=None):
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    targets = plain_targets(sizes, weights or ranked(sizes), share, most)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(abs(r.target - float(targets[s])) <= 1e-9 * max(1, targets[s]) for r in mine)
        assert sum(r.taken for r in mine) == floor(targets[s])
        assert all(0 <= r.part <= r["size"] and r.taken == r.epochs * r["size"] + r.part <= most * r["size"] for r in mine)
        # whole documents but for one at the cut
        assert sum(0 < r.part < r["size"] for r in mine) <= 1


def test_edge_rows(mixed_docs):
    rows = M.mix_sources(mixed_docs).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == sorted(
        (str(r.doc_id), len(words(r.text))) for r in mixed_docs.collect())
    check(rows)


def test_ranges_copies_and_reruns(llm_spark, docs, monkeypatch):
    some = docs.select("doc_id", "text", "source")
    many = some.union(some.where("doc_id < 3").crossJoin(llm_spark.range(40)).select(some.columns))
    first = M.mix_sources(many)
    monkeypatch.setattr(M, "COPIES", 7)
    monkeypatch.setattr(M, "RANGE_ROWS", 16)
    again = M.mix_sources(many.repartition(13))
    rows = first.collect()
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))
    check(rows)


def test_weights_table_and_texts(llm_spark, docs):
    names = [r.source for r in docs.select("source").distinct().collect()]
    weights = {s: (i % 4) for i, s in enumerate(sorted(names))}
    table = llm_spark.createDataFrame(list(weights.items()), "source string, weight int")
    mix = M.mix_sources(docs, weights=table, share=Fraction(7, 10), max_epochs=3, keep=("text", "lang"))
    rows = mix.collect()
    check(rows, Fraction(7, 10), 3, weights)
    taken = {}
    for r in M.mixed_texts(mix).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
    want = {}
    for r in rows:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == {k: v for k, v in want.items() if v}


def test_empty_table_and_clash(llm_spark, empty):
    assert M.mix_sources(empty.withColumn("source", F.lit("x"))).count() == 0
    blank = llm_spark.createDataFrame([(1, None, "x"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in M.mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        M.mix_sources(empty, keep=("taken",))
