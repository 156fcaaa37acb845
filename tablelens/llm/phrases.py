"""Phrase collocation mining by prefix-free parsing (operator 12).

Texts are cut at punctuation into pieces and those into words. A run of
``max_words - 1`` words whose hash is divisible by ``PERIOD`` is a trigger: a
chunk ends with a trigger and the next one begins with it, so chunks overlap by
``max_words - 1`` words and the cuts depend on content alone: copied passages
give the same chunks. The distinct chunks with their frequencies are the
dictionary. N-grams are counted inside the distinct chunks, weighted by these
frequencies; an n-gram that starts in the overlap belongs to the next chunk
only, where it is whole.

The counts go up level by level, from words to runs of ``max_words - 1`` words: an n-gram
is counted only where both (n-1)-grams in it may be frequent, by a bit field
of hashes, which errs on the safe side only. The last pass counts the phrases
themselves, as text, so no count rests on a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablelens.llm.stage import Steps
from tablelens.llm.words import hash_words, mix, window_hashes

#: One of so many windows is a trigger.
PERIOD = 32
#: Bytes of text taken at once, and counts kept in a task before they are passed on.
BLOCK = 1 << 20
HELD = 1 << 20
#: The bit field of a level has 16 bits per frequent n-gram, within these bounds (32 MB at most).
MIN_BITS, MAX_BITS = 20, 28

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte run, and the piece of each."""
    if not len(data):
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = ~_GAP[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.cumsum(_BREAK[data], dtype=np.int32)[starts]


def _gather(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many slices one after another, and their offsets."""
    offsets = np.zeros(len(begins) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    place = np.arange(offsets[-1], dtype=np.int64)
    place += np.repeat(begins - offsets[:-1], lengths)
    return data[place], offsets


def _strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    out, offsets = _gather(data, begins, ends - begins)
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words one after another, each followed by a space, and where each begins."""
    out, offsets = _gather(np.append(data, np.uint8(32)), starts, ends - starts + 1)
    out[offsets[1:] - 1] = 32
    return out, offsets


def _chunks(data: np.ndarray, span: int, more: bool):
    """Chunks of a byte run as (texts, words owned), and the place from which the
    bytes are to be read again with what follows (if there is ``more``)."""
    starts, ends, piece = _tokens(data)
    n = len(starts)
    if not n:
        return None, len(data)
    first = np.ones(n, dtype=bool)
    first[1:] = piece[1:] != piece[:-1]
    head = first.copy()
    if n >= span:
        w = window_hashes(hash_words(data, starts, ends, False), span)
        head[: len(w)] |= (w % np.uint64(PERIOD) == 0) & (piece[: len(w)] == piece[span - 1:])
    at = np.flatnonzero(head)
    nxt = np.append(at[1:], n)
    inner = np.append(~first[at[1:]], False)        # the next chunk is of the same piece
    stop = np.where(inner, nxt + span, nxt)
    rest = len(data)
    if more:
        # the last chunk may go on, and the chunk before it needs no more words
        rest = int(starts[at[-1]])
        if len(data) - rest >= BLOCK and n - span > at[-1]:
            # BLOCK bytes without a trigger: the chunk ends here, the next one takes its last words again
            nxt[-1], stop[-1], rest = n - span, n, int(starts[n - span])
        else:
            at, nxt, stop = at[:-1], nxt[:-1], stop[:-1]
        if not len(at):
            return None, rest
    text, offsets = _spaced(data, starts, ends)
    return (_strings(text, offsets[at], offsets[stop] - 1), nxt - at), rest


def _runs(texts: Iterator[str], size: int = BLOCK) -> Iterator[bytes]:
    """Texts joined by line breaks, about ``size`` bytes at once."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield "\n".join(held).encode("utf-8", "surrogatepass")
            held, n = [], 0
    if held:
        yield "\n".join(held).encode("utf-8", "surrogatepass")


def _blocks(data: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """A very long run in blocks that end between words: (block, more follow)."""
    begin, n = 0, len(data)
    while n - begin > 2 * BLOCK:
        cut = begin + BLOCK
        while cut < n and not _GAP[data[cut]]:
            cut += 1
        yield data[begin:cut], cut < n
        begin = cut
    if begin < n:
        yield data[begin:], False


def _parse(span: int):
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("own", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, text = batch.column(0), batch.column(1)
            for name in lang.unique().to_pylist():
                mine = text.filter(pa.compute.equal(lang, name))
                for run in _runs(t.as_py() for t in mine if t.is_valid):
                    left = np.zeros(0, dtype=np.uint8)
                    for block, more in _blocks(_LOWER[np.frombuffer(run, dtype=np.uint8)]):
                        data = np.concatenate((left, block)) if len(left) else block
                        out, rest = _chunks(data, span, more)
                        left = data[rest:]
                        if out is not None:
                            yield pa.record_batch([pa.array([name] * len(out[1]), pa.string()), out[0].cast(pa.string()),
                                                   pa.array(out[1], pa.int32())], schema=schema)

    return run


def chunk_dictionary(docs: DataFrame, max_words: int = 5) -> DataFrame:
    """Distinct chunks: lang, chunk (words joined by a space), own (n-grams that
    start at its first ``own`` words are its own), freq."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    parsed = rows.mapInArrow(_parse(max_words - 1), "lang string, chunk string, own int")
    return parsed.groupBy("lang", "chunk", "own").agg(F.count(F.lit(1)).alias("freq"))


def _dictionary_runs(batches: Iterator[pa.RecordBatch]):
    """Rows of the dictionary by language, about BLOCK bytes at once: (lang, bytes
    of the chunks in lines, starts, ends, row, own words and frequency per row)."""
    for batch in batches:
        lang = batch.column(0)
        for name in lang.unique().to_pylist():
            mine = batch.filter(pa.compute.equal(lang, name))
            ends = np.cumsum(pa.compute.binary_length(mine.column(1)).to_numpy(zero_copy_only=False))
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(BLOCK, ends[-1] + BLOCK, BLOCK)), len(ends)))
            begin = 0
            for cut in cuts.tolist():
                part = mine.slice(begin, cut - begin)
                begin = cut
                if not len(part):
                    continue
                data = np.frombuffer("\n".join(part.column(1).to_pylist()).encode(), dtype=np.uint8)
                starts, stops, row = _tokens(data)
                yield name, data, starts, stops, row, part.column(2).to_numpy(), part.column(3).to_numpy()


def _salt(lang: str, n: int) -> np.uint64:
    code = int.from_bytes(lang.encode()[:64] + bytes([n]), "little") % ((1 << 64) - 59)
    return mix(np.array([code], dtype=np.uint64))[0]


def _keys(h: np.ndarray, n: int, lang: str) -> np.ndarray:
    return mix((window_hashes(h, n) if n > 1 else h) ^ _salt(lang, n))


def _may_be(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _own_starts(row: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Words at which an n-gram starts that lies in the row and is its own."""
    count = len(row) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=bool)
    first = np.searchsorted(row, np.arange(len(own)))
    place = np.arange(len(row)) - first[row]
    return (row[:count] == row[n - 1:]) & (place[:count] < own[row[:count]])


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], np.add.reduceat(weights, at) if len(at) else weights


def _count_level(n: int, below):
    """Counts of n-gram hashes, where both (n-1)-grams may be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            k, w = _summed(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            return pa.record_batch([pa.array(k.view(np.int64)), pa.array(w)], names=["key", "f"])

        bits = np.frombuffer(below.value, dtype=np.uint8) if below is not None else None
        for lang, data, starts, stops, row, own, freq in _dictionary_runs(batches):
            good = _own_starts(row, own, n)
            if not len(good):
                continue
            h = hash_words(data, starts, stops, False)
            if bits is not None:
                low = _may_be(bits, _keys(h, n - 1, lang))
                good &= low[:-1] & low[1:]
            at = np.flatnonzero(good)
            k, w = _summed(_keys(h, n, lang)[at], freq[row[at]].astype(np.int64))
            held.append((k, w))
            size += len(k)
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _count_phrases(levels: list, max_words: int):
    """Counts of phrases as text: those of n words that may be frequent by level
    n, or (for the longest) whose two parts may be frequent by the level below."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(b.value, dtype=np.uint8) for b in levels]
        for lang, data, starts, stops, row, own, freq in _dictionary_runs(batches):
            h = hash_words(data, starts, stops, False)
            may = None
            for n in range(1, max_words + 1):
                good = _own_starts(row, own, n)
                if not len(good):
                    break
                # of n words: by its own level; beyond the levels: by its parts
                may = _may_be(bits[n - 1], _keys(h, n, lang)) if n <= len(bits) else may[:-1] & may[1:]
                at = np.flatnonzero(good & may)
                if not len(at):
                    continue
                # a chunk's words are joined by one space, so the phrase is a slice
                texts = _strings(data, starts[at], stops[at + n - 1])
                table = pa.table({"phrase": texts, "f": pa.array(freq[row[at]].astype(np.int64))})
                table = table.group_by("phrase").aggregate([("f", "sum")])
                m = table.num_rows
                yield pa.record_batch([pa.array([lang] * m, pa.string()), pa.array(np.full(m, n, dtype=np.int32)),
                                       table.column("phrase").combine_chunks().cast(pa.string()),
                                       table.column("f_sum").combine_chunks()], schema=schema)

    return run


def _bit_field(frequent: DataFrame) -> bytes:
    """One bit per hash: 16 bits for each frequent n-gram, of fixed least and
    greatest size. Fuller fields let more through, and nothing is lost."""
    count = frequent.count()
    bits = min(MAX_BITS, max(MIN_BITS, (16 * count).bit_length()))
    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    rows = frequent.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(F.lit(0x7FFF)).alias("bit")) \
        .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    field = bytearray(1 << (bits - 3))
    for r in rows:
        field[r.part << 12:(r.part + 1) << 12] = r.bits
    return bytes(field)


def count_phrases(docs: DataFrame, *, max_words: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``max_words`` words with at least ``min_count`` occurrences:
    (lang, n, phrase, f), and the words of each language: (lang, words).

    ``docs`` needs lang and text; other columns do not matter. Words are runs of
    other bytes than space and tab in the pieces between ``. , ; : ! ?`` and
    0x0A-0x0D, A-Z folded. Null lang counts as ``und``, a null, empty or
    white text has no words, rows that repeat count each time, an empty table
    gives two empty tables. Texts of any length are read in blocks.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    chunks = steps.write("chunks", chunk_dictionary(docs, max_words))
    words = steps.write("words", chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("words")))
    levels = []
    for n in range(1, max_words):
        counted = chunks.mapInArrow(_count_level(n, levels[-1] if levels else None), "key long, f long")
        frequent = steps.write(f"level{n}", counted.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count).select("key"))
        levels.append(spark.sparkContext.broadcast(_bit_field(frequent)))
        steps.drop(f"level{n}")
    texts = chunks.mapInArrow(_count_phrases(levels, max_words), "lang string, n int, phrase string, f long")
    phrases = steps.write("phrases", texts.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count))
    for field in levels:
        field.destroy()
    steps.drop("chunks")
    return phrases, words


def collocations(docs: DataFrame, *, max_words: int = 5, min_count: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank (from 1), phrase, a, l,
    r, n, score. ``a`` counts the phrase; the cut into a first part (``l``) and a rest
    (``r``) with the lowest ``score = floor(1000 * a * n / (l * r))`` counts, of
    equal ones the earliest; n counts all words of the language. A phrase that
    lies in a longer one as frequent as itself is left out. Order: score, a
    (both descending), phrase. Cases of null, empty, repeated rows: see
    ``count_phrases``. Sums and products are exact (decimals of 38 digits)."""
    phrases, words = count_phrases(docs, max_words=max_words, min_count=min_count)
    parts = phrases.where("n >= 2").select("lang", "phrase", "n", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    f = phrases.select("lang", "phrase", "f")

    def joined(first, length):
        return F.array_join(F.slice("w", first, length), " ")

    cuts = parts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(words) if words.count() <= 4096 else words, "lang")
    score = F.expr("cast(1000 * cast(a as decimal(19,0)) * cast(words as decimal(15,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("b"))

    # every shorter phrase inside a phrase, with the count of the longer one
    inside = parts.where("n >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n") - 1))) \
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1))) \
        .select("lang", joined(F.col("i"), F.col("m")).alias("phrase"), "a")
    covered = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = best.join(covered, ["lang", "phrase"], "left").where("longer is null or longer < b.a")
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("b.a").desc(), F.col("phrase"))
    ranked = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(f"b.{c}").alias(c) for c in "alr"],
                         F.col("b.words").alias("n"), F.col("b.score").alias("score"))
