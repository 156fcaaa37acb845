"""Nearest neighbours: recall against brute force, exact scores and ties."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tablelens.llm.prefix_forest import PrefixForest, nearest_neighbours


def brute(ids, vectors, queries, k):
    out = {}
    for i, x in zip(ids, vectors):
        if i in queries:
            score = (np.array([v for v in vectors]) * x).sum(axis=1)
            near = sorted((-s, j) for s, j in zip(score, ids) if j != i)[:k]
            out[i] = near
    return out


def test_recall_and_scores(llm_spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    df = llm_spark.read.parquet(path)
    rows = df.select("vec_id", "embedding").collect()
    ids = [r["vec_id"] for r in rows]
    vectors = np.array([r["embedding"] for r in rows], dtype=float)
    out = nearest_neighbours(df, F.col("vec_id") % 20 == 0, shard_rows=700, query_block=40).collect()
    want = brute(ids, vectors, {i for i in ids if i % 20 == 0}, 20)
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    place = {i: k for k, i in enumerate(ids)}
    recall = []
    for q, near in want.items():
        assert len(got[q]) == 20 and got[q] == sorted(got[q])
        assert all(abs(-s - float(vectors[place[q]] @ vectors[place[j]])) < 1e-12 for s, j in got[q])
        recall.append(len({j for _, j in got[q]} & {j for _, j in near}) / 20)
    assert np.mean(recall) >= 0.9


def test_recall_with_production_shards(llm_spark, tmp_path):
    """Several full shards of clustered vectors of unequal norm, default parameters."""
    random = np.random.RandomState(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = unit(random.randn(400, 64))
    vectors = unit(centres[random.randint(400, size=40_000)] + 0.5 * unit(random.randn(40_000, 64)))
    vectors *= np.exp(0.5 * random.randn(40_000, 1))
    path = str(tmp_path / "vectors.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(40_000)), "embedding": pa.array(list(vectors))}), path)
    out = nearest_neighbours(llm_spark.read.parquet(path), F.col("vec_id") % 400 == 0).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in range(0, 40_000, 400):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        recall.append(len(got[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_odd_vectors(llm_spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 5), (20, [0.0, 2.0], 5), (1, [3.0, 1.0], 1), (2, [3.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1),
            (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [], 1), (None, [1.0, 1.0], 1),
            (9, [1.0, 1.0, 1.0], 1), (2, [3.0, 1.0], 1), (40, None, 1), (10, [-5.0, 0.5], 1)]
    df = llm_spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    out = nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=3).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 3.0), (2, 3.0), (20, 0.0)], 20: [(1, 2.0), (2, 2.0), (10, 1.0)]}
    many = nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=50).collect()
    assert sum(r["query_id"] == 0 for r in many) == 4
    assert nearest_neighbours(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_longer_prefixes_are_narrower():
    random = np.random.RandomState(0)
    vectors = random.standard_normal((500, 12))
    forest = PrefixForest(vectors, float(np.linalg.norm(vectors, axis=1).max()), trees=5)
    low, high = forest.ranges(vectors[:20])
    size = high - low
    assert (size[0] == 500).all() and (np.diff(size, axis=0) <= 0).all()
    for wanted in (1, 60, 500 * 5):
        for rows in forest.candidates(vectors[:20], wanted):
            assert len(rows) >= min(wanted, 500) / 5
    assert all(len(r) == 500 for r in forest.candidates(vectors[:3], 500 * 5))
