"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a string of 64 bits: the sides of 64 hyperplanes, taken
as orthogonal frames so that a string's bits say different things. A tree is the
sorted array of the strings of its rows. A query descends every tree to its
longest prefix matches (a binary search; longer prefixes are narrower ranges of
the array) and then ascends all trees together, one bit at a time, until the
ranges hold the wanted share of rows. Only those candidates are scored exactly.

Largest inner product becomes nearest direction by one more component,
``sqrt(M**2 - |x|**2)`` with the largest norm M, which queries have as zero.

Rows are dealt evenly (by a hash of the id) to shards of at most about
``shard_rows`` rows, each with its own trees; the stated query set goes to the
shards in blocks of ``query_block``. A task holds one shard and one block. Each
sends its best ``k`` per query on, and the best of all shards are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablelens.llm.stage import Steps

BITS = 64


def _frames(tree: int, width: int, seed: int) -> np.ndarray:
    """BITS hyperplanes of a tree: rows of random orthogonal matrices."""
    random = np.random.RandomState((seed * 7919 + tree) % (1 << 32))
    parts = []
    while sum(len(p) for p in parts) < BITS:
        q, r = np.linalg.qr(random.standard_normal((width, width)))
        parts.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(parts)[:BITS]


def _strings(vectors: np.ndarray, frames: np.ndarray) -> np.ndarray:
    bits = vectors @ frames.T > 0
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


class PrefixForest:
    """Sorted arrays of hash strings of a shard's vectors."""

    def __init__(self, vectors: np.ndarray, top_norm: float, trees: int, seed: int = 5):
        self.vectors, self.trees, self.seed = vectors, trees, seed
        extra = np.sqrt(np.maximum(top_norm ** 2 - (vectors ** 2).sum(axis=1), 0.0))
        lifted = np.concatenate((vectors, extra[:, None]), axis=1)
        self.order, self.keys = [], []
        for t in range(trees):
            s = _strings(lifted, _frames(t, lifted.shape[1], seed))
            o = np.argsort(s, kind="stable")
            self.order.append(o)
            self.keys.append(s[o])

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds per (depth, tree, query) of the rows that share the first
        ``depth`` bits, for depths 0 .. BITS (of one longest prefix and all
        its ascents); as far down as a range still holds a row."""
        n, q = len(self.vectors), len(queries)
        lifted = np.concatenate((queries, np.zeros((q, 1))), axis=1)
        deep = min(BITS, max(1, int(math.log2(max(n, 2))) + 8))
        low = np.empty((deep + 1, self.trees, q), dtype=np.int32)
        high = np.empty_like(low)
        for t in range(self.trees):
            s = _strings(lifted, _frames(t, lifted.shape[1], self.seed))
            for depth in range(deep + 1):
                if depth == 0:
                    low[0, t], high[0, t] = 0, n
                    continue
                rest = np.uint64(BITS - depth)
                begin = (s >> rest) << rest
                low[depth, t] = np.searchsorted(self.keys[t], begin, side="left")
                high[depth, t] = np.searchsorted(self.keys[t], begin | np.uint64((1 << int(rest)) - 1), side="right")
        return low, high

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """Rows per query: all trees ascend together from the deepest level
        until their ranges hold ``wanted`` rows, counted over the trees."""
        low, high = self.ranges(queries)
        held = (high - low).sum(axis=1)  # depth by query, falling with depth
        depth = (held >= min(wanted, self.trees * len(self.vectors))).sum(axis=0) - 1
        for j in range(len(queries)):
            d = depth[j]
            hit = np.zeros(len(self.vectors), dtype=bool)
            for t in range(self.trees):
                hit[self.order[t][low[d, t, j]:high[d, t, j]]] = True
            yield np.flatnonzero(hit)


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, trees: int,
                 wanted: int, top_norm: float):
    """Best k rows of a shard per query: (query id, id, score)."""
    forest = PrefixForest(vectors, top_norm, trees)
    out_q, out_v, out_s = [], [], []
    for j, rows in enumerate(forest.candidates(queries, wanted)):
        rows = rows[ids[rows] != query_ids[j]]
        if len(rows) == 0:
            continue
        rough = vectors[rows] @ queries[j]
        if len(rows) > k:
            floor = np.partition(rough, len(rows) - k)[len(rows) - k]
            rows = rows[rough >= floor - 1e-9 * max(1.0, abs(floor))]
        # equal vectors get equal scores: the same sum for every row
        score = (vectors[rows] * queries[j]).sum(axis=1)
        best = np.lexsort((ids[rows], -score))[:k]
        out_q.append(np.full(len(best), query_ids[j]))
        out_v.append(ids[rows[best]])
        out_s.append(score[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
                       trees: int = 48, share: float = 1.0, shard_rows: int = 1 << 14,
                       query_block: int = 1 << 11) -> DataFrame:
    """(query_id, rank, id, score): per query row the ``k`` rows with the largest
    inner products found (fewer, if there are fewer), nearest first, ties to the
    smaller id; never the query's own id.

    ``is_query``: condition on the columns of ``vectors``. ``share``: part of a
    shard's rows that the ascent gathers before it stops, counted over the
    trees (and always so many that a tree holds 8 * k, or the whole shard); more
    gives a higher recall. Vectors that are null, empty, all zero or
    hold null or non-finite components, and rows without id, take no part. An id
    that repeats counts once, with its smallest vector. Vectors of different
    lengths are not compared. Other columns are only for ``is_query``. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    steps = Steps(spark)
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = (vectors.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
            .groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
            .withColumn("dim", F.size("v")))
    rows = steps.write("vectors", rows)
    n, asked, norm = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / query_block))
    top = float(norm or 0.0)
    deal = F.xxhash64("id", F.lit(8))
    base = rows.withColumn("shard", F.pmod(deal, F.lit(shards)).cast("int"))
    # every row to each block of queries, every query to each shard
    index = base.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = (rows.where("asks").withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(blocks)).cast("int"))
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
        if own.num_rows == 0 or asking.num_rows == 0:
            return schema.empty_table()
        # one tree at least then holds 8 * k rows, or all of a small shard
        wanted = max(math.ceil(share * own.num_rows), trees * min(own.num_rows, 8 * k))
        found = search_shard(own.column("id").to_numpy(), _matrix(own.column("v")), asking.column("id").to_numpy(),
                             _matrix(asking.column("v")), k, trees, wanted, top)
        return pa.table([pa.array(x) for x in found], schema=schema)

    columns = ["dim", "shard", "block", "id", "v"]
    found = (index.select(columns).groupBy("dim", "shard", "block")
             .cogroup(queries.select(columns).groupBy("dim", "shard", "block"))
             .applyInArrow(search, "query_id long, id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
