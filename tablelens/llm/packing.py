"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents become ids in Arrow batches (one pass over the texts, a written
step); only lengths travel further. Pieces that fill a sequence are placed at
once. The others are dealt evenly, by their row numbers, to shards of about
``shard_pieces`` pieces, so that neither a hot source nor copies matter, and
each shard is packed by the sum-of-squares rule, longest piece first: a piece
goes to the open sequence for which the sum over all residual gaps of (number
of open sequences with that gap)**2 becomes smallest; a new sequence is opened
where none has room. A shard's state is one count per possible gap. Every shard
leaves less than a sequence or so open, so the waste does not grow with the
number of documents in a shard.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablelens.llm.stage import Steps

SHARD_PIECES = 1 << 16
PUBLIC_JSON = "byte_bpe_50k.json"
PUBLIC_RANKS = "byte_bpe_50k.tiktoken"
_SPECIAL = "<|endoftext|>"
_loaded: dict[tuple, object] = {}


def public_path(name: str) -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of the byte-level BPE vocabulary, equal to those of its JSON file.

    The rank file holds the same vocabulary and its encoder is several times
    as fast; texts with the special token's string go through the JSON file,
    whose encoder gives that string one id."""

    def __init__(self, json_file: str, rank_file: str | None):
        from tokenizers import Tokenizer

        self._json = Tokenizer.from_file(json_file)
        self._ranks = None
        if rank_file:
            import public_tokenizers
            import tiktoken
            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                            special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self._ranks is None or _SPECIAL in text:
            return np.array(self._json.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self._ranks.encode_to_numpy(text, disallowed_special=())


def tokenizer(json_file: str | None = None, rank_file: str | None = None) -> ByteBpe:
    """The encoder of this process (paths are looked up where it runs)."""
    key = (json_file, rank_file)
    if key not in _loaded:
        if json_file is None:
            _loaded[key] = ByteBpe(public_path(PUBLIC_JSON), public_path(PUBLIC_RANKS))
        else:
            _loaded[key] = ByteBpe(json_file, rank_file)
    return _loaded[key]


def _pieces(capacity: int, end_id: int, payload: str, json_file: str | None, rank_file: str | None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(json_file, rank_file)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        for batch in batches:
            ids_in, texts = batch.column(0), batch.column(1)
            out = ([], [], [], [], [], [])
            for r in range(batch.num_rows):
                ids = np.append(encoder.encode(texts[r].as_py() or ""), np.uint32(end_id)).astype("<u4")
                total = len(ids)
                head = total % capacity if total > capacity else total
                ends = list(range(head or capacity, total + 1, capacity))
                start = 0
                for piece, end in enumerate(ends):
                    part = ids[start:end]
                    out[0].append(r)
                    out[1].append(number)
                    out[2].append(piece)
                    out[3].append(start)
                    out[4].append(end - start)
                    out[5].append(zlib.crc32(part) if payload == "crc32" else part.astype(np.int32))
                    number += 1
                    start = end
                if payload == "ids" and len(out[0]) >= 256:
                    yield batch_of(ids_in, out)
                    out = ([], [], [], [], [], [])
            if out[0]:
                yield batch_of(ids_in, out)

    def batch_of(ids_in, out):
        rows, numbers, piece, start, length, load = out
        if payload == "crc32":
            load = pa.array(load, pa.int64())
        else:
            offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            load = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(load)))
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), ids_in.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
             pa.array(start, pa.int64()), pa.array(length, pa.int64()), load],
            names=["row", "doc_id", "piece", "start", "length", payload])

    return cut


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) per piece: longest first, ties in the given order."""
    n = len(lengths)
    sequence, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by residual gap
    open_at: dict[int, list[int]] = {}
    made = 0
    for k in np.argsort(-lengths, kind="stable"):
        size = int(lengths[k])
        gaps = np.flatnonzero(count[size:]) + size
        if len(gaps):
            left = gaps - size
            change = 1 - 2 * count[gaps] + np.where(left > 0, 2 * count[left] + 1, 0)
            gap = int(gaps[int(np.argmin(change))])
            s = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, s = capacity, made
            made += 1
        sequence[k], offset[k] = s, capacity - gap
        if gap > size:
            count[gap - size] += 1
            open_at.setdefault(gap - size, []).append(s)
    return sequence, offset


def _pack_shard(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        sequence, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        shard = table.column("shard")[0].as_py()
        return pa.table({"row": table.column("row"), "sequence_id": pa.array(sequence + (shard << 32)),
                         "offset": pa.array(offset)})

    return pack


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
                   end_id: int = 0, payload: str = "ids", json_file: str | None = None, rank_file: str | None = None,
                   shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids or ids_crc32,
    sequence_id, offset).

    A document's ids are its text's (null: empty) and ``end_id``. Only documents
    longer than ``capacity`` are cut, at multiples of it from their end, so only
    the first piece may be shorter. ``payload``: "ids" returns each piece's ids,
    "crc32" their unsigned CRC-32 (little-endian 32-bit ids) instead. Offsets in
    a sequence are gapless from 0. Repeated rows and repeated or null ids are
    documents of their own; other columns are not read; an empty table gives an
    empty result. ``json_file`` / ``rank_file``: vocabulary files (default: the
    installed public ones); they must exist on every executor.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    load = {"ids": "ids array<int>", "crc32": "crc32 long"}[payload]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = steps.write("pieces", source.mapInArrow(
        _pieces(capacity, end_id, payload, json_file, rank_file),
        f"row long, doc_id long, piece int, start long, length long, {load}"))
    small = pieces.where(F.col("length") < capacity).select("row", "length")
    shards = max(1, math.ceil(small.count() / shard_pieces))
    placed = (small.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
              .groupBy("shard").applyInArrow(_pack_shard(capacity), "row long, sequence_id long, offset long"))
    full = pieces.where(F.col("length") == capacity).select(
        "row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = pieces.join(placed.union(full), "row")
    load = "ids" if payload == "ids" else F.col("crc32").alias("ids_crc32")
    return out.select("doc_id", "piece", "start", "length", load, "sequence_id", "offset")
