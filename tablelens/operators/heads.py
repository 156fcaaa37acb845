"""H1 / H2: first values per column and first / last rows, in table order."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import rows_frame
from ..functions.types import order_columns
from .order import default_order


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _unpivoted_heads(df: DataFrame, cols: list[str], positions: list[int], order: list[str], k: int) -> DataFrame:
    """One scan: columns unpivoted, ``row_number() <= k`` per column (planned as
    a partial WindowGroupLimit before the shuffle, so only k rows per column
    and input partition move)."""
    parts = ", ".join(f"{i}L, '{c.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', "
                      f"CAST({_quoted(c)} AS STRING)" for i, c in zip(positions, cols))
    keys = [F.col(o).alias(f"_k{j}") for j, o in enumerate(order)]
    long = (df.select(F.expr(f"stack({len(cols)}, {parts}) AS (position, column, value)"), *keys)
            .filter(F.col("value").isNotNull()))
    w = Window.partitionBy("column").orderBy(*[F.col(f"_k{j}") for j in range(len(order))])
    return (long.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= k).select("column", "position", "rank", "value"))


def head_values(df: DataFrame, cols: Sequence[str], order: Sequence[str] | str | None = None,
                k: int = 50) -> DataFrame:
    """H1: the first ``k`` non-null values of every column in ``cols``, in
    table order: (column, position, rank, value), from one scan of the table
    that reads only these columns and the order key, for any number of columns.
    At most ``k`` rows per column and input partition leave the scan."""
    order = default_order(df, order)
    cols = list(cols)
    if not cols:
        return rows_frame(df.sparkSession, [], "column string, position bigint, rank bigint, value string")
    return _unpivoted_heads(df, cols, list(range(len(cols))), order, k)


@dataclass
class HeadRead:
    """Rows found in the first files of a table, and how many files that took."""

    rows: DataFrame
    files_read: int
    files: int


#: Operators after which a table is no longer a plain scan of its files.
_NO_SCAN = ("Aggregate", "Join", "Sort", "Window", "Repartition", "Union", "Limit", "Generate", "MapInArrow")


def _file_prefixes(df: DataFrame):
    """The rows of the first 1, 2, 4, ... files in table order, and at last the
    whole table: (table, files, all files). Only for a scan of several files in
    the loader's file order, where a condition on the path keeps the other files
    from being opened; else the whole table at once."""
    marked = order_columns(df)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    scan = marked and "_metadata" in plan and not any(w in plan for w in _NO_SCAN)
    # a path without a host is written scheme:/path in the metadata
    files = sorted((re.sub("^([^/:]+):///", r"\1:/", f) for f in df.inputFiles()), key=str.encode) if scan else []
    n = 1
    while n < len(files):
        yield df.filter(F.col(f"`{marked[0]}`") <= F.lit(files[n - 1])), n, len(files)
        n *= 2
    yield df, max(len(files), 1), max(len(files), 1)


def read_heads(df: DataFrame, cols: Sequence[str], k: int = 50) -> HeadRead:
    """H1 by an escalating read: the first ``k`` non-null values of every column in
    file order, from the first files that hold them. The files are taken in order, twice
    as many each time, until every column has its ``k`` values or the table ends;
    the same rows as ``head_values``."""
    cols = list(cols)
    order = default_order(df, None)
    for part, n, total in _file_prefixes(df):
        heads = head_values(part, cols, order, k)
        if n == total:
            return HeadRead(heads, n, total)
        found = {r["column"]: r["count"] for r in heads.groupBy("column").count().collect()}
        if all(found.get(c, 0) >= k for c in cols):
            return HeadRead(heads, n, total)
    raise AssertionError("the last prefix is the whole table")


def read_first(df: DataFrame, n: int = 50) -> HeadRead:
    """S6 by an escalating read: the first ``n`` rows in file order."""
    order = default_order(df, None)
    for part, k, total in _file_prefixes(df):
        first = part.orderBy(*[F.col(f"`{c}`").asc() for c in order]).limit(n)
        if k == total or part.limit(n).count() == n:
            return HeadRead(first, k, total)
    raise AssertionError("the last prefix is the whole table")


def head_tail(df: DataFrame, order: Sequence[str] | str | None = None, first: int = 15,
              last: int = 5, n_rows: int | None = None) -> DataFrame:
    """H2: the first ``first`` rows and, when the table has more than ``first``
    rows, the last ``last`` rows: adds (part, rank)."""
    order = default_order(df, order)
    n = df.count() if n_rows is None else n_rows
    head = (df.orderBy(*[F.col(c).asc() for c in order]).limit(first)
            .withColumn("part", F.lit("first"))
            .withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("bigint")))
    if n <= first:
        return head
    tail = (df.orderBy(*[F.col(c).desc() for c in order]).limit(last)
            .withColumn("part", F.lit("last"))
            .withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("bigint")))
    return head.unionByName(tail)
