"""CSV with quoted line breaks, read in parallel (one file, many splits).

Whether a line break ends a record depends on all quotes before it in the file.
So each split is first looked at without knowing its beginning: what state (in or
outside a quoted cell) it ends in, for either state it may begin with. The
splits' functions compose in file order, which gives every split its true
beginning; then each split is cut into records by itself. A record that runs over
the end of a split is put together from its fragments (at most two a split).

Lines are read by Spark's text source, which splits files; only lines with a quote
are looked at one by one. The records are parsed by Spark's own CSV parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _scanner(sep: str):
    """``after(line, quoted)``: the state after a line, given the state before it."""
    opening = sep + '"'

    def after(line: str, quoted: bool) -> bool:
        i = 0
        if not quoted:
            if not line.startswith('"'):
                k = line.find(opening)
                if k < 0:
                    return False
                i = k + len(opening)
            else:
                i = 1
        while True:
            j = line.find('"', i)           # in a quoted cell
            if j < 0:
                return True
            if line.startswith('"', j + 1):
                i = j + 2
                continue
            k = line.find(opening, j + 1)   # what follows a closing quote is plain text up to the next cell
            if k < 0:
                return False
            i = k + len(opening)

    return after


def _split_ends(sep: str):
    """Per split: the state at its end, from either state at its beginning."""
    after = _scanner(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, states, rows = None, None, []
        for batch in batches:
            for file, block, line in zip(*[c.to_pylist() for c in batch.columns]):
                if (file, block) != place:
                    if place is not None:
                        rows.append((*place, *states))
                    place, states = (file, block), (False, True)
                states = (after(line, states[0]), after(line, states[1]))
        if place is not None:
            rows.append((*place, *states))
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_()))],
                              names=["file", "block", "from_plain", "from_quoted"])

    return run


def _cut_records(sep: str, known):
    """Splits cut into records: (file, block, pos, kind, first, crlf, record). ``pos``
    counts the lines of the split; ``first`` marks the first record of a file.
    ``known``: the splits that begin quoted, and the files with CR LF."""
    after = _scanner(sep)
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("kind", pa.int32()),
                        ("first", pa.bool_()), ("crlf", pa.bool_()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, crlf = known.value
        place, quoted, held, begin, number, at_head = None, False, [], 0, 0, False
        kind = _WHOLE
        out: list[tuple] = []

        def emit():
            batch = pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out.clear()
            return batch

        def close():
            # what is open when a split ends goes on in the next one
            if held:
                out.append((*place, begin, _TAIL if kind == _TAIL else _HEAD, at_head, place[0] in crlf, "\n".join(held)))

        for batch in batches:
            files, blocks, lines = batch.columns
            n = len(lines)
            if not n:
                continue
            cuts = [0]
            if files[0] != files[n - 1] or blocks[0] != blocks[n - 1]:
                f, b = files.to_pylist(), blocks.to_pylist()
                cuts += [i for i in range(1, n) if f[i] != f[i - 1] or b[i] != b[i - 1]]
            for lo, hi in zip(cuts, [*cuts[1:], n]):
                here = (files[lo].as_py(), blocks[lo].as_py())
                if here != place:
                    if place is not None:
                        close()
                    place, held, number = here, [], 0
                    quoted = here in starts
                    kind, at_head = (_TAIL if quoted else _WHOLE), here[1] == 0
                run_lines = lines.slice(lo, hi - lo)
                if not quoted and not held and not at_head and not pc.any(pc.match_substring(run_lines, '"')).as_py():
                    # no quote at all: the lines are the records
                    trimmed = pc.replace_substring_regex(run_lines, "\r$", "")
                    m = hi - lo
                    keep = pc.not_equal(trimmed, "")
                    cols = [pa.array([place[0]] * m, pa.string()), pa.array([place[1]] * m, pa.int64()),
                            pa.array(range(number, number + m), pa.int64()), pa.array([_WHOLE] * m, pa.int32()),
                            pa.array([False] * m), pa.array([False] * m), trimmed]
                    if out:
                        yield emit()
                    yield pa.record_batch(cols, schema=schema).filter(keep)
                    number += m
                    continue
                for line in run_lines.to_pylist():
                    if not held and not quoted:
                        begin = number
                    number += 1
                    if '"' in line:
                        quoted = after(line, quoted)
                    if quoted:
                        held.append(line)
                        continue
                    held.append(line[:-1] if line.endswith("\r") else line)
                    record = "\n".join(held)
                    if record or kind == _TAIL:
                        out.append((*place, begin, kind, at_head and kind == _WHOLE, place[0] in crlf, record))
                        at_head = at_head and kind == _TAIL
                    held, kind = [], _WHOLE
                if len(out) >= 4096:
                    yield emit()
        if place is not None:
            close()
        if out:
            yield emit()

    return run


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), "value")


def quoted_splits(spark: SparkSession, path: str, sep: str = ",") -> tuple[set, set, bool]:
    """The splits that begin inside a quoted cell, the files whose first line ends
    with CR LF, and whether any record runs over the end of a split or file. One row per split comes to the driver, for each of two scans."""
    lines = csv_lines(spark, path)
    numbered = lines.select("file", "block", F.endswith("value", F.lit("\r")).alias("cr"), F.monotonically_increasing_id().alias("n"))
    every = numbered.groupBy("file", "block").agg(F.min_by("cr", "n").alias("crlf")).collect()
    ends = lines.where(F.contains("value", F.lit('"'))).mapInArrow(
        _split_ends(sep), "file string, block long, from_plain boolean, from_quoted boolean")
    # lines without a quote leave the state as it is, so splits without one do too
    known = {(r["file"], r["block"]): (r["from_plain"], r["from_quoted"]) for r in ends.collect()}
    starts, state = set(), {}
    for file, block in sorted((r["file"], r["block"]) for r in every):
        quoted = state.get(file, False)
        if quoted:
            starts.add((file, block))
        state[file] = known[file, block][quoted] if (file, block) in known else quoted
    return starts, {r["file"] for r in every if r["block"] == 0 and r["crlf"]}, bool(starts) or any(state.values())


def has_quoted_breaks(spark: SparkSession, path: str, sep: str = ",") -> bool:
    """Whether any record of the files runs over a line break (lines without a
    quote are not looked at)."""
    after = _scanner(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # outside of quotes, the first record with a line break shows as a line that ends quoted
        for batch in batches:
            if any(after(line, False) for line in batch.column(0).to_pylist()):
                yield pa.record_batch([pa.array([True])], names=["found"])
                return

    quoted = csv_lines(spark, path).where(F.contains("value", F.lit('"'))).select("value")
    return quoted.mapInArrow(run, "found boolean").limit(1).count() > 0


def csv_records(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """The records of the files behind ``path`` as text columns named ``columns``,
    with (file, block, pos) in ``place``: their order. The first record
    of each file is its header and left out; empty lines are skipped."""
    known = quoted_splits(spark, path, sep)
    pieces = csv_lines(spark, path).mapInArrow(_cut_records(sep, spark.sparkContext.broadcast(known[:2])),
                                               "file string, block long, pos long, kind int, first boolean, crlf boolean, record string")
    whole = pieces.where(F.col("kind") == _WHOLE).drop("kind")
    if known[2]:
        # fragments of the records that run over the end of a split
        parts = pieces.where(F.col("kind") != _WHOLE).withColumn("turn", F.when(F.col("kind") == _TAIL, 0).otherwise(1))
        before = Window.partitionBy("file").orderBy("block", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = parts.withColumn("owner", F.last(F.when(F.col("kind") == _HEAD, F.col("block")), ignorenulls=True).over(before))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "turn", "record"))), lambda x: x["record"]), "\n")
        joined = parts.groupBy("file", F.col("owner").alias("block")).agg(
            F.max(F.when(F.col("kind") == _HEAD, F.col("pos"))).alias("pos"), F.max("first").alias("first"), F.max("crlf").alias("crlf"),
            text.alias("record"))
        whole = whole.union(joined.select(whole.columns))
    text = F.when(F.col("crlf"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    parsed = F.from_csv(text, F.lit(", ".join(f"c{i} string" for i in range(len(columns)))),
                        {"sep": sep, "escape": '"', "multiLine": "true"})
    rows = whole.where(~F.col("first")).select(F.struct("file", "block", "pos").alias("place"), parsed.alias("r"))
    return rows.select("place", *[F.col("r")[f"c{i}"].alias(c) for i, c in enumerate(columns)])
