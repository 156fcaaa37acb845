"""Order-dependent work over the physical order of files, without a shuffle of
rows (W1, W3b).

A split of a file is a contiguous, ordered run of rows that one task reads in
order. So forward fill and row numbers are a parallel prefix scan over splits:

1. one aggregate per split (rows, last non-null value of each column): as many
   small rows as there are splits;
2. prefixes over the splits in file order: the value carried into each split and the
   number of rows before it (on the driver: one entry per split, that is
   per ``spark.sql.files.maxPartitionBytes`` of data);
3. each split is filled, or numbered, by itself while it is read.

Tables come from ``load_table(path, blocks=True)`` (or a CSV), with the marked order
columns (file, split, place in it); projections, filters and new columns keep the
physical order, shuffles do not. Both passes must cut files alike; the second
checks that a split is known, its rows ascend and their number is the one counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import column_classes, order_columns, with_marks_of


def scan_order(df: DataFrame) -> tuple[str, str, str]:
    """The marked (file, split, place) columns of a table read in physical order."""
    names = order_columns(df)
    if len(names) != 3:
        raise ValueError("physical order needs load_table(..., blocks=True)")
    return names[0], names[1], names[2]


def _splits(df: DataFrame, aggs: Sequence) -> list:
    """One row per split, in file order."""
    file, block, _ = scan_order(df)
    rows = df.groupBy(F.col(file).alias("file"), F.col(block).alias("block")).agg(F.count(F.lit(1)).alias("rows"), *aggs).collect()
    return sorted(rows, key=lambda r: (r["file"].encode(), r["block"]))


def _split_runs():
    """The function that goes to the tasks (with its own code, so that executors
    need not have this package)."""
    def runs(batches: Iterator[pa.RecordBatch], places: tuple[int, int, int], known: dict):
        """Slices of one split each: (its key, slice, rows of the split before it)."""
        file, block, place = places
        key, seen, last = None, 0, -1

        def done():
            if key is not None and known[key][0] != seen:
                raise ValueError(f"split {key} has {seen} rows, not {known[key][0]}: not in physical order")

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            f, b, p = batch.column(file), batch.column(block), batch.column(place)
            cuts = [0]
            if n > 1:
                new = pc.or_(pc.not_equal(f.slice(1), f.slice(0, n - 1)), pc.not_equal(b.slice(1), b.slice(0, n - 1)))
                if pc.any(new).as_py():
                    cuts += [i + 1 for i, x in enumerate(new.to_pylist()) if x]
            for lo, hi in zip(cuts, [*cuts[1:], n]):
                here = (f[lo].as_py(), b[lo].as_py())
                if here != key:
                    done()
                    if here not in known:
                        raise ValueError(f"unknown split {here}: not in physical order")
                    key, seen, last = here, 0, -1
                run = p.slice(lo, hi - lo)
                ascends = hi - lo < 2 or pc.all(pc.greater(run.slice(1), run.slice(0, hi - lo - 1))).as_py()
                if not ascends or run[0].as_py() <= last:
                    raise ValueError(f"rows of split {here} do not ascend: not in physical order")
                last = run[hi - lo - 1].as_py()
                yield key, batch.slice(lo, hi - lo), seen
                seen += hi - lo
        done()

    return runs


def forward_fill_scan(df: DataFrame, cols: Sequence[str], then: object | None = None) -> DataFrame:
    """W1 in physical order: ``last(c, ignorenulls)`` over all rows up to each, for
    every column of ``cols``; ``then`` fills what is still null. The same rows as
    ``forward_fill``, with no exchange of rows. An empty table stays empty."""
    cols = list(cols)
    if not cols:
        return df
    file, block, place = scan_order(df)
    last = [F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(place))).alias(f"v{i}") for i, c in enumerate(cols)]
    carry = [None] * len(cols)
    known = {}
    for r in _splits(df, last):
        known[r["file"], r["block"]] = (r["rows"], tuple(carry))
        carry = [v if v is not None else old for v, old in zip((r[f"v{i}"] for i in range(len(cols))), carry)]
    carried = df.sparkSession.sparkContext.broadcast(known)
    names = df.columns
    at = [names.index(c) for c in cols]
    places = (names.index(file), names.index(block), names.index(place))
    runs = _split_runs()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = carried.value
        state: dict = {}
        for key, part, seen in runs(batches, places, known):
            if not seen:
                state = dict(zip(at, known[key][1]))
            columns = list(part.columns)
            for i in at:
                x = pc.fill_null_forward(columns[i]) if columns[i].null_count else columns[i]
                if x.null_count and state[i] is not None:
                    x = pc.fill_null(x, pa.scalar(state[i], x.type))
                if x[len(x) - 1].is_valid:
                    state[i] = x[len(x) - 1].as_py()
                if then is not None and x.null_count:
                    x = pc.fill_null(x, pa.scalar(then, x.type))
                columns[i] = x
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return with_marks_of(df.mapInArrow(fill, schema), df)


def index_scan(df: DataFrame, name: str = "_idx") -> DataFrame:
    """Every row with its 0-based position in physical order, with no exchange."""
    file, block, place = scan_order(df)
    known, total = {}, 0
    for r in _splits(df, []):
        known[r["file"], r["block"]] = (r["rows"], total)
        total += r["rows"]
    before = df.sparkSession.sparkContext.broadcast(known)
    names = df.columns
    places = (names.index(file), names.index(block), names.index(place))
    runs = _split_runs()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = before.value
        for key, part, seen in runs(batches, places, known):
            start = known[key][1] + seen
            place = pa.array(range(start, start + part.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, place], names=[*part.schema.names, name])

    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in df.schema.fields], T.StructField(name, T.LongType())])
    return with_marks_of(df.mapInArrow(number, schema), df)


def row_sample_scan(df: DataFrame, cols: Sequence[str] | None = None, rows: int = 30) -> DataFrame:
    """W3b in physical order: every ``step``-th row, ``step = max(1, n // rows)``,
    the first ``rows`` of them; (index, value columns...). The same rows as
    ``row_sample`` in file order, with no exchange."""
    cols = list(cols) if cols is not None else column_classes(df).numeric[:4]
    base = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*cols, *scan_order(df)])])
    n = base.count()
    step = max(1, n // rows)
    picked = index_scan(base).where((F.col("_idx") % step == 0) & (F.col("_idx") < rows * step))
    return picked.select((F.col("_idx") / step).cast("bigint").alias("index"), *[F.col(f"`{c}`") for c in cols])
