"""Connected components of an edge table, by alternating star contraction.

Each round joins edges with per-node minima (large star, then small star), so
no component, link list or label is ever gathered in one place; the rounds
grow with the logarithm of the longest chain. Every round is a written step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablelens.llm.stage import Steps


def connected_components(edges: DataFrame, steps: Steps) -> DataFrame:
    """``edges``: columns a, b (any order, repeats and loops allowed; null ends
    are dropped). Returns (node, component): the smallest node reachable, for
    each node that has an edge to another one. An empty table gives none."""
    def tidy(e: DataFrame) -> DataFrame:
        return (e.where("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    current = steps.write("star", tidy(edges.select("a", "b")))
    mark = _mark(current)
    number = 0
    while mark[0]:
        number += 1
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        # large star: every larger neighbour moves to the smallest node around
        large = (both.where("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.least("a", "low").alias("b")))
        large = tidy(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        # small star: every smaller neighbour, and the node, move to the smallest
        small = large.join(low, "a")
        small = small.select("a", F.col("low").alias("b")).union(small.select("b", "low"))
        name = f"star{number}"
        nxt = steps.write(name, tidy(small))
        after = _mark(nxt)
        steps.drop("star" if number == 1 else f"star{number - 1}")
        current = nxt
        if after == mark:
            break
        mark = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return (row[0], row[1])
