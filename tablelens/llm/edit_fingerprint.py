"""Document fingerprints by a randomised embedding of edit distance.

A shared random walk reads a text: at step j it looks at the character under
its pointer, notes it, and moves on or stays, as a random bit of (j, character)
says. Two texts with few edits fall back into step after each edit, so the notes
of the two walks differ in few places: edit distance becomes Hamming distance.

A text of up to 3,599 characters is one walk. A longer one is cut where its own
content says so: the next block starts 3,584 to 5,119 characters after the last,
at the smallest hash of 16 characters there (the first of equals). So after an
insertion of k characters the cuts fall on the same characters again, within a
block for most k far below 1,536, and the walks of all later blocks are equal;
blocks are numbered, so an insertion of a block's length or more does put later
blocks out of step. Block b owns the steps from ``b * 15360``; all blocks of a
batch walk in step with each other. A fingerprint samples the notes: each of its
256 places keeps four hashed bits of the note at one of its own steps, the one of
smallest random rank that the text reaches. So texts of nearly equal length
sample the same steps, whatever that length is; a place that a short text does
not reach stays open. The likeness of two fingerprints is their share of equal
places, less what chance gives.

Equal texts have equal fingerprints. Near copies are found by bands of places
and verified on the whole fingerprint (``near_copies``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablelens.llm.components import connected_components
from tablelens.llm.stage import Steps, ship_package
from tablelens.llm.words import mix

PLACES = 256
BLOCK_CHARS = 5120  # the longest block
_CUT_FROM, _CUT_CHARS = 3584, 16  # where its end may fall at the earliest, and what a cut looks at
_STEPS = 3 * BLOCK_CHARS
_OPEN = 255
_NO_RANK = np.iinfo(np.uint64).max
_GROUP_CHARS = 1 << 22
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


class _Walk:
    """The shared randomness: per step a hash of characters, and the sampled steps."""

    def __init__(self):
        step = mix(np.arange(1, _STEPS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.add = (step >> np.uint64(32)).astype(np.uint32)
        self.times = (step & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
        self.samples: list[dict[int, tuple[int, np.uint64]]] = []
        # smallest rank of each place among the steps that every text with the next block reaches
        self._sure = np.full(PLACES, _NO_RANK, dtype=np.uint64)

    @staticmethod
    def ranks(b: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, rank) of every step of block b."""
        j = np.arange(b * _STEPS, (b + 1) * _STEPS, dtype=np.uint64)
        place = (mix(j + np.uint64(0x1234567)) % np.uint64(PLACES)).astype(np.int64)
        return place, mix(j * np.uint64(0xD1342543DE82EF95) + np.uint64(99))

    def block(self, b: int) -> dict[int, tuple[int, np.uint64]]:
        """Step -> (place, rank) of the steps of block b that a place can come from:
        smaller than all before in the block, and than what is surely reached."""
        while len(self.samples) <= b:
            place, rank = self.ranks(len(self.samples))
            low = self._sure.copy()
            found = {}
            for s in np.flatnonzero(rank < low[place]):
                if rank[s] < low[place[s]]:
                    low[place[s]] = rank[s]
                    found[int(s)] = int(place[s]), rank[s]
            self.samples.append(found)
            # a step reads at most one character, and a block with a next one has more of them
            np.minimum.at(self._sure, place[:_CUT_FROM], rank[:_CUT_FROM])
        return self.samples[b]


_walk: list[_Walk] = []


def block_starts(chars: np.ndarray) -> list[int]:
    """First characters of a text's blocks (code points; empty: no block)."""
    starts = [0] if len(chars) else []
    while starts and (n := min(len(chars) - starts[-1] - _CUT_CHARS + 1, BLOCK_CHARS) - _CUT_FROM) > 0:
        seen = chars[starts[-1] + _CUT_FROM:starts[-1] + _CUT_FROM + n + _CUT_CHARS - 1]
        value = np.zeros(n, dtype=np.uint64)
        for k in range(_CUT_CHARS):
            value = value * np.uint64(0x100000001B3) + seen[k:k + n]
        starts.append(starts[-1] + _CUT_FROM + int(np.argmin(mix(value))))
    return starts


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of PLACES values 0..15 per text, 255 where a place is open."""
    if not _walk:
        _walk.append(_Walk())
    walk = _walk[0]
    n = len(texts)
    digits = np.full((n, PLACES), _OPEN, dtype=np.uint8)
    best = np.full((n, PLACES), _NO_RANK, dtype=np.uint64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    chars = np.concatenate((np.frombuffer(raw, dtype=np.uint32), np.zeros(256, dtype=np.uint32)))
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if n else np.zeros(0, dtype=np.int64)
    blocks = (lengths > 0).astype(np.int64)
    cuts = {int(x): block_starts(chars[first[x]:first[x] + lengths[x]]) for x in np.flatnonzero(lengths > _CUT_FROM)}
    for x, starts in cuts.items():
        blocks[x] = len(starts)
    doc = np.repeat(np.arange(n), blocks)
    begin = np.cumsum(blocks) - blocks
    number = np.arange(len(doc)) - np.repeat(begin, blocks)
    at = first[doc]
    for x, starts in cuts.items():
        at[begin[x]:begin[x] + len(starts)] += starts
    end = first[doc] + lengths[doc]
    inner = np.flatnonzero(number[1:])  # followed by a block of the same text
    end[inner] = at[inner + 1]
    order = np.argsort(number, kind="stable")
    doc, number, at, end = doc[order], number[order], at[order], end[order]
    schedule: dict[int, list] = {}
    for b in range(int(number[-1]) + 1 if len(number) else 0):
        for j, sampled in walk.block(b).items():
            schedule.setdefault(j, []).append((b, *sampled))
    for j in range(_STEPS):
        if j % 64 == 0:
            alive = at < end
            if not alive.all():
                doc, number, at, end = doc[alive], number[alive], at[alive], end[alive]
            if len(at) == 0:
                break
        note = chars[at]
        note ^= walk.add[j]
        note *= walk.times[j]
        for b, place, rank in schedule.get(j, ()):
            lo, hi = np.searchsorted(number, (b, b + 1))
            ok = np.flatnonzero(at[lo:hi] < end[lo:hi]) + lo
            if len(ok):
                ok = ok[best[doc[ok], place] > rank]
                digits[doc[ok], place] = (note[ok] >> np.uint32(27)) & np.uint32(15)
                best[doc[ok], place] = rank
        at += note >> np.uint32(31)
    return digits


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common notes, 0 to 1, row by row; 1 if both are open everywhere."""
    filled = ((a != _OPEN) | (b != _OPEN)).sum(axis=1)
    equal = ((a == b) & (a != _OPEN)).sum(axis=1)
    share = np.where(filled > 0, equal / np.maximum(filled, 1), 1.0)
    return np.clip((share - 1 / 16) / (1 - 1 / 16), 0.0, 1.0)


def as_text(digits: np.ndarray) -> list[str]:
    """Fingerprints as strings of hexadecimal digits, ``-`` for an open place."""
    letters = np.where(digits == _OPEN, np.uint8(45), _HEX[np.minimum(digits, 15)])
    return [bytes(row).decode("ascii") for row in letters]


def from_text(texts: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(texts).encode("ascii"), dtype=np.uint8).reshape(len(texts), PLACES)
    return np.where(raw == 45, np.uint8(_OPEN), np.where(raw >= 97, raw - 87, raw - 48)).astype(np.uint8)


def edited(text: str, following: str) -> str:
    """The last third replaced by the beginning of another text."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _fingerprint_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by bucket, then own rows in order, then the first row of the
    bucket after it. Holds one group of rows and the row before it."""
    def work(rows):
        """Rows (bucket, id, text, is own); the last one is only looked at."""
        own = [r[2] for r in rows]
        pairs = [k for k in range(len(rows) - 1) if rows[k][3] and rows[k][0] == rows[k + 1][0]]
        changed = [edited(own[k], own[k + 1]) for k in pairs]
        prints = fingerprints(own + changed)
        mine, new = prints[:len(own)], prints[len(own):]
        k = np.array(pairs, dtype=np.int64)
        shown = as_text(mine)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[x][1] for x in pairs], pa.int64()), pa.array([len(own[x]) for x in pairs], pa.int64()),
             pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], pa.string()),
             pa.array([shown[x] for x in pairs], pa.string()), pa.array(as_text(new), pa.string()),
             pa.array(likeness(mine[k], new)), pa.array(likeness(mine[k], mine[k + 1]))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows, size = [], 0
    for batch in batches:
        for bucket, edge, i, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
            rows.append((bucket, i, text, not edge))
            size += len(text)
            if size >= _GROUP_CHARS and len(rows) > 1:
                yield work(rows)
                rows, size = rows[-1:], len(rows[-1][2])
    if len(rows) > 1:
        yield work(rows)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).

    A document's edited text has its last third replaced by the beginning of the
    next document's. Next: by descending id (ids that are null last, equal ids by
    descending text); after the last document the first. Null texts are empty;
    repeated rows are documents of their own; a single document is its own next;
    other columns are not read; an empty table gives an empty result.

    Documents are dealt once into ranges of ids (quantiles of the ids, read
    alone); the first document of each range also goes to the range before it.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parts = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = source.agg(F.percentile_approx("doc_id", [(k + 1) / parts for k in range(parts - 1)] or [0.5], 10_000)).first()[0]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.arrow_udf("int")
    def bucket_of(ids: pa.Array) -> pa.Array:
        # larger ids first; ids that are null come last
        value = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        value[~ids.is_valid().to_numpy(zero_copy_only=False)] = len(bounds) + 1
        return pa.array(value.astype(np.int32))

    heads = (source.select("doc_id").withColumn("bucket", bucket_of("doc_id")).groupBy("bucket")
             .agg(F.max("doc_id").alias("head")).orderBy("bucket").collect())  # one row per range
    if not heads:
        return source.select("doc_id", *[F.lit(None).cast(t).alias(n) for n, t in _OUT_FIELDS[1:]])
    before = [heads[k - 1]["bucket"] for k in range(len(heads))]  # the range that looks at this one's head
    edges = spark.createDataFrame([(h["head"], b) for h, b in zip(heads, before)], "head long, target int")
    edge = source.join(F.broadcast(edges), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("target").agg(
        F.first("head").alias("doc_id"), F.max("text").alias("text"))
    rows = source.select(bucket_of("doc_id").alias("bucket"), F.lit(False).alias("edge"), "doc_id", "text").union(
        edge.select(F.col("target").alias("bucket"), F.lit(True).alias("edge"), "doc_id", "text"))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions(
        F.col("bucket"), F.col("edge"), F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return rows.mapInArrow(_fingerprint_edits, _OUT)


_OUT_FIELDS = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"),
               ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
_OUT = ", ".join(f"{n} {t}" for n, t in _OUT_FIELDS)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row; a null text is an empty one."""
    ship_package(docs.sparkSession)

    @F.arrow_udf("string")
    def made(column: pa.Array) -> pa.Array:
        return pa.array(as_text(fingerprints([x or "" for x in column.to_pylist()])), pa.string())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), made(F.col(text_col).cast("string")).alias("fingerprint"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 32,
                threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fingerprint, class_id).

    Fingerprints are cut into bands of places; those that agree on a band are
    candidates, compared as neighbours in the order of their whole fingerprints
    and with the band's smallest one, and linked when their likeness reaches
    ``threshold``. Classes are what links connect, named by their smallest id.
    Equal fingerprints are one node, so copies cost nothing; a band of any size
    gives at most two candidates per node. A sampled method: a pair whose likeness
    is near the threshold may be missed (recall of classes against all pairs in
    the tests: 0.9 at least). An open place counts as a sign of its own (near texts
    reach nearly the same places), a band that is open throughout as none: short
    texts have the bands that they reach, and those without any are linked only
    to equal ones. Rows without id form classes without id.
    """
    steps = Steps(docs.sparkSession)
    prints = steps.write("prints", fingerprint_documents(docs, id_col, text_col))
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.xxhash64("fingerprint"))
    width = PLACES // bands
    keys = F.explode(F.array(*[F.concat(F.lit(f"{b}:"), F.substring("fingerprint", b * width + 1, width))
                               for b in range(bands)]))
    entries = nodes.select("node", "fingerprint", keys.alias("band")).where(
        F.regexp_like("band", F.lit(":.*[0-9a-f]")))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = head = before = None
        for batch in batches:
            a, b = [], []
            for key, node, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if key != band:
                    band, head, before = key, (node, text), None
                else:
                    for other in {head, before or head}:
                        a.append(other)
                        b.append((node, text))
                before = (node, text)
            if a:
                good = likeness(from_text([x[1] for x in a]), from_text([x[1] for x in b])) >= threshold
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x, g in zip(a, good) if g], pa.int64()),
                     pa.array([x[0] for x, g in zip(b, good) if g], pa.int64())], names=["a", "b"])

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    links = (entries.select("band", "node", "fingerprint").repartition(parts, "band")
             .sortWithinPartitions("band", "fingerprint").mapInArrow(candidates, "a long, b long"))
    labels = connected_components(links, steps).select(F.col("node").alias("n"), "component")
    named = nodes.join(labels, F.col("node") == F.col("n"), "left").withColumn("label", F.coalesce("component", "node"))
    lowest = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = named.join(lowest, "label").select("fingerprint", "class_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "class_id")
