"""Substring dedup: cut word spans that an earlier document already holds.

A window is ``window`` consecutive words. Each word covered by a window whose
words also start in a document with a smaller id goes. The reference text is
the corpus itself, in shards that documents visit:

1. Anchors. Of the short word runs inside a window the one with the smallest
   hash is its anchor; equal windows have equal anchors, and neighbouring
   windows mostly share theirs, so a text has one anchor for several words.
   The anchors (hash, id) are shuffled; those of one document only are dropped.
2. Shards. Documents meet their shared anchors by id. Each maximal run of
   windows with one shared anchor becomes a segment (its text), and segments
   are shuffled by anchor: an anchor's segments are one reference shard. The
   shard is streamed by ascending id. It keeps a suffix automaton of the
   distinct segments so far, whose states know the first document that holds
   them; each segment's matching statistics against it tell which windows are
   in an earlier document. Equal segments are matched whole, so copies cost a
   lookup. An automaton lives in the task that streams its shard; no shard is
   broadcast, since the reference grows with the corpus.
3. A shard of more than ``shard_segments`` different segments (a very common
   phrase in many surroundings) is split: the rest of its windows are shuffled
   by the window itself, and a window goes if its run begins with a smaller id.
4. Removed windows return to their rows by id and text (a hash of it: rows with
   one id may hold different texts) and the spans are cut.

All of this is linear in the number of words, whatever is repeated how often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tablelens.llm import words as W
from tablelens.llm.stage import Steps

_ANCHOR_WORDS = 5


class SuffixAutomaton:
    """All factors of the word sequences added so far; every state knows the
    first owner (in the order of adding) of its factors."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, step: dict, link: int, length: int, owner) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.owner[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, sequence, owner) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new = self._state({}, 0, self.length[last] + 1, owner)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def owners(self, sequence, window: int) -> list:
        """First owner of each window of ``window`` words of a sequence, None
        where the automaton does not hold it (its matching statistics, taken
        as far as the window's length)."""
        out, state, matched = [], 0, 0
        for k, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            while self.length[self.link[state]] >= window if state else False:
                state = self.link[state]
            if matched >= window:
                matched = window
            if k >= window - 1:
                out.append(self.owner[state] if matched >= window else None)
        return out


def anchor_segments(hashes: np.ndarray, first: np.ndarray, window: int):
    """Segments of a group of rows: (row, anchor, first window, number of
    windows), windows counted from the start of the group's words. ``first``:
    first word of each row, then the total."""
    k = min(_ANCHOR_WORDS, window)
    count = len(hashes) - window + 1
    none = np.zeros(0, dtype=np.int64)
    if count <= 0:
        return none, none.astype(np.uint64), none, none
    grams = W.window_hashes(hashes, k)
    low = grams[:count].copy()
    for i in range(1, window - k + 1):
        np.minimum(low, grams[i:i + count], out=low)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:count]
    at = np.flatnonzero(np.arange(count) + window <= first[1:][row])
    if len(at) == 0:
        return none, none.astype(np.uint64), none, none
    row, low = row[at], low[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return row[begin], low[begin], at[begin], np.diff(np.concatenate((begin, [len(at)])))


def _anchors(window: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = W.column_bytes(batch.column(1))
            for i, j in W.text_groups(offsets):
                h, _, _, first = W.words_of_rows(data, offsets, i, j, lower=False)
                row, anchor, _, _ = anchor_segments(h, first, window)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[i + row])],
                                                     names=["anchor", "doc_id"])

    return make


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, anchor) of the anchors that two documents hold; input sorted by
    (anchor, doc_id). Only a run's first id is kept while the run is open."""
    anchor = first = None
    told = False
    for batch in batches:
        if batch.num_rows == 0:
            continue
        a, d = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True])))
        s, e = edges[:-1], edges[1:]
        keep_a, keep_d = [], []
        head = d[s].copy()
        mixed = d[e - 1] != head
        if a[0] == anchor:
            mixed[0] = told or d[e[0] - 1] != first
            if mixed[0] and not told:
                keep_a.append(a[:1])
                keep_d.append(np.array([first]))
            head[0] = first
        take = np.repeat(mixed, e - s)
        take[1:] &= (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        anchor, first, told = a[-1], head[-1], bool(mixed[-1])
        keep_a.append(a[take])
        keep_d.append(d[take])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keep_d)), pa.array(np.concatenate(keep_a))],
                                         names=["doc_id", "anchor"])


def _segments(window: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = W.column_bytes(batch.column(1))
            keys = batch.column(3).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            shared = lists.values.to_numpy(zero_copy_only=False)
            bounds = lists.offsets.to_numpy()
            for i, j in W.text_groups(offsets):
                h, s, e, first = W.words_of_rows(data, offsets, i, j, lower=False)
                row, anchor, begin, count = anchor_segments(h, first, window)
                anchor = anchor.view(np.int64)
                hit = np.zeros(len(row), dtype=bool)
                ends = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(j - i):
                    x, y = ends[r], ends[r + 1]
                    if y > x:
                        hit[x:y] = np.isin(anchor[x:y], shared[bounds[i + r]:bounds[i + r + 1]])
                row, anchor, begin, count = row[hit], anchor[hit], begin[hit], count[hit]
                if len(row) == 0:
                    continue
                left, right = s[begin], e[begin + count + window - 2]
                size = right - left
                to = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                flat = data[np.repeat(left - to[:-1], size) + np.arange(to[-1])]
                content = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.tobytes()),
                                                                        pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(ids[i + row]), pa.array(keys[i + row]), pa.array(begin - first[row]), content],
                    names=["anchor", "doc_id", "text_key", "begin", "content"])

    return make


_MARK = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("begin", pa.int64()), ("windows", pa.int64()), ("content", pa.binary())])


def _runs(flags) -> Iterator[tuple[int, int]]:
    at = None
    for k, flag in enumerate(flags):
        if flag and at is None:
            at = k
        elif not flag and at is not None:
            yield at, k - at
            at = None
    if at is not None:
        yield at, len(flags) - at


def _match(window: int, shard_segments: int):
    """Streams shards: input sorted by (anchor, doc_id). Rows out: windows to
    remove (content null), or segments of a split shard (windows -1: a
    reference, windows 0: a segment to judge)."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, known, automaton, split = None, {}, None, False
        out: tuple[list, ...] = ([], [], [], [], [])

        def put(*row):
            for c, x in zip(out, row):
                c.append(x)

        for batch in batches:
            for a, doc, key, begin, content in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if a != anchor:
                    anchor, known, automaton, split = a, {}, None, False
                if split:
                    put(doc, key, begin, 0, content)
                    continue
                seen = known.get(content)
                if seen is None:
                    if len(known) >= shard_segments:
                        split = True
                        for text, (owner, _, _) in known.items():
                            put(owner, 0, -1, -1, text)
                        put(doc, key, begin, 0, content)
                        known, automaton = {}, None
                        continue
                    sequence = W.split_words(content)
                    if not known:
                        owners = [doc] * (len(sequence) - window + 1)
                    else:
                        if automaton is None:
                            automaton = SuffixAutomaton()
                            for owner, before, _ in known.values():
                                automaton.add(before, owner)
                        owners = [doc if o is None else o for o in automaton.owners(sequence, window)]
                        automaton.add(sequence, doc)
                    seen = known[content] = (doc, sequence, owners)
                owner, _, owners = seen
                if owner < doc:
                    put(doc, key, begin, len(owners), None)
                else:
                    for at, count in _runs([o < doc for o in owners]):
                        put(doc, key, begin + at, count, None)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, _MARK)], schema=_MARK)
                out = ([], [], [], [], [])

    return match


def _split_windows(window: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, begin, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            data, offsets = W.column_bytes(batch.column(4).cast(pa.string()))
            for i, j in W.text_groups(offsets):
                h, _, _, first = W.words_of_rows(data, offsets, i, j, lower=False)
                g = W.window_hashes(h, window)
                for r in range(i, j):
                    a, b = first[r - i], first[r - i + 1] - window + 1
                    at = np.arange(b - a) + begin[r] if kind[r] == 0 else np.full(b - a, -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[a:b].view(np.int64)), pa.array(np.full(b - a, doc[r])),
                         pa.array(np.full(b - a, key[r])), pa.array(at)], names=["hash", "doc_id", "text_key", "begin"])

    return make


def _split_match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = first = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        h, d, text, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        head = d[edges[:-1]].copy()
        if h[0] == key:
            head[0] = first
        key, first = h[-1], head[-1]
        take = (np.repeat(head, np.diff(edges)) < d) & (at >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(d[take]), pa.array(text[take]), pa.array(at[take]),
                                          pa.array(np.ones(int(take.sum()), dtype=np.int64))],
                                         names=["doc_id", "text_key", "begin", "windows"])


def _cut(window: int, payload: str, id_name: str, text_name: str):
    """Remove the marked windows from each text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_name))
            data, offsets = W.column_bytes(text)
            marks = batch.column(batch.num_columns - 1)
            valid = marks.is_valid().to_numpy(zero_copy_only=False)
            n_words, n_removed, kept, spans = [], [], [], []
            for i, j in W.text_groups(offsets):
                _, s, e, first = W.words_of_rows(data, offsets, i, j, lower=False)
                for r in range(i, j):
                    a, b = int(first[r - i]), int(first[r - i + 1])
                    gone = np.zeros(b - a + 1, dtype=np.int32)
                    if valid[r]:
                        pair = marks[r].values
                        begin, count = (pair.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                        np.add.at(gone, begin, 1)
                        np.add.at(gone, begin + count + window - 1, -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    if payload == "digest":
                        keep = np.flatnonzero(~gone) + a
                        kept.append(hashlib.sha256(_joined(data, s[keep], e[keep])).hexdigest())
                    else:
                        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                        pieces = [(int(s[a + x] - offsets[r]), int(e[a + y - 1] - offsets[r]))
                                  for x, y in zip(edges[::2], edges[1::2])]
                        raw = bytes(data[offsets[r]:offsets[r + 1]])
                        spans.append([{"start": x, "end": y} for x, y in pieces])
                        kept.append(None if not text[r].is_valid else _without(raw, pieces).decode("utf-8"))
            fixed = [batch.column(k) for k in range(batch.num_columns - 1)]
            if payload == "text":
                fixed[batch.schema.get_field_index(text_name)] = pa.array(kept, text.type)
                extra = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names = [*batch.schema.names[:-1], "n_words", "n_removed", "removed"]
            else:
                fixed = [batch.column(batch.schema.get_field_index(id_name))]
                extra = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                names = [id_name, "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(fixed + extra, names=names)

    return cut


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space."""
    if len(starts) == 0:
        return b""
    size = ends - starts + 1
    to = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(starts - to[:-1], size) + np.arange(to[-1])
    out = data[np.minimum(source, len(data) - 1)]
    out[to[1:] - 1] = 32
    return out[:-1].tobytes()


def _without(raw: bytes, pieces: list[tuple[int, int]]) -> bytes:
    """A text without byte spans; of the white space around a cut the part
    before it stays, and none at the text's ends."""
    if not pieces:
        return raw
    out, at = [], 0
    for a, b in pieces:
        out.append(raw[at:a])
        at = b
    rest = raw[at:]
    kept = out[0]
    for part in [*out[1:], rest]:
        trimmed = part.lstrip(b" \t\n\v\f\r")
        kept = kept + trimmed if kept and trimmed else kept or trimmed
    return kept.rstrip(b" \t\n\v\f\r") if not rest.strip(b" \t\n\v\f\r") else kept


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                          payload: str = "text", shard_segments: int = 4096) -> DataFrame:
    """Cut each word covered by a window of ``window`` words that also starts in
    a document with a smaller id; windows are judged on the input.

    ``payload`` "text": all columns of ``docs``, the text without its removed
    spans (a text that loses nothing is unchanged to the byte), then n_words,
    n_removed, removed (array of byte spans start, end of the input text).
    "digest": id, n_words, n_removed, kept_sha256 (kept words joined by a space).

    Words are compared as they are. Null texts have no words and stay null.
    Rows without id give and lose nothing; rows with equal ids are one document
    as far as the order goes, each with its own text. Texts shorter than a window keep all. Columns named
    like the added ones are refused in "text" mode. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    if payload == "text" and {"n_words", "n_removed", "removed"} & set(docs.columns):
        raise ValueError("docs has a column n_words, n_removed or removed")
    source = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    shared = steps.write("shared", source.mapInArrow(_anchors(window), "anchor long, doc_id long")
                         .repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id")
                         .mapInArrow(_shared, "doc_id long, anchor long"))
    lists = shared.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    segments = source.join(lists, "doc_id").select("doc_id", "text", "anchors", F.xxhash64("text")).mapInArrow(
        _segments(window), "anchor long, doc_id long, text_key long, begin long, content binary")
    marks = steps.write("marks", segments.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id")
                        .mapInArrow(_match(window, shard_segments),
                                    "doc_id long, text_key long, begin long, windows long, content binary"))
    steps.drop("shared")
    gone = marks.where("content is null").select("doc_id", "text_key", "begin", "windows")
    if not marks.where("content is not null").isEmpty():
        rest = (marks.where("content is not null")
                .mapInArrow(_split_windows(window), "hash long, doc_id long, text_key long, begin long")
                .repartition(parts, "hash").sortWithinPartitions("hash", "doc_id")
                .mapInArrow(_split_match, "doc_id long, text_key long, begin long, windows long"))
        gone = gone.union(steps.write("split", rest))
    gone = gone.groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")).agg(
        F.collect_list(F.struct("begin", "windows")).alias("__marks"))
    joined = docs.join(gone, (F.col(id_col).cast("long") == F.col("__doc"))
                       & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__key")), "left")
    if payload == "digest":
        joined = joined.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col),
                               "__marks")
        schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string"
    else:
        joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__marks")
        schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()),
                               T.StructField("n_removed", T.LongType()),
                               T.StructField("removed", T.ArrayType(T.StructType(
                                   [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return joined.mapInArrow(_cut(window, payload, id_col, text_col), schema)
