"""SentencePiece encoding and decoding of documents.

A unigram model: the pieces of a text are those of the path with the largest sum
of log scores through the lattice of all pieces that match somewhere (Viterbi).
Pieces are looked up in a double-array trie over characters. A character that no
piece starts is an unknown one (the lowest score less 10) and becomes its UTF-8
bytes where the vocabulary has byte pieces. Spaces travel as the marker U+2581,
one of which is put before the text.

The path is found unit by unit: a unit is a run of markers with the characters
up to the next marker, or an unknown character. No piece reaches over the end of
a unit (checked when a model is read; otherwise a text is one unit), so the best
path of a text is the best paths of its units, and equal units of a batch are
solved once, those of one length together in arrays: a step of the trie or of
Viterbi is taken for all of them at once. The model is read on the driver and broadcast (it is as large as
its vocabulary file); documents are one narrow pass, without a shuffle.
"""

from __future__ import annotations

import math
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablelens.llm.stage import ship_package

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: Characters of text whose units are solved together, and units of one array.
_TOGETHER = 1 << 22
_UNITS = 1 << 15
#: Longer units are solved by themselves.
_LONG = 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            size = {5: 4, 1: 8}[kind]
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class DoubleArray:
    """A trie in two arrays: from node s, the child for code c is base[s] + c if
    check[base[s] + c] is s. ``value`` is the piece that ends at a node, or -1."""

    def __init__(self, words: list[tuple[str, int]]):
        self.codes = {c: k for k, c in enumerate(sorted({c for w, _ in words for c in w}), 1)}
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, number in words:
            node = 0
            for c in word:
                code = self.codes[c]
                nxt = children[node].get(code)
                if nxt is None:
                    nxt = children[node][code] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = number
        self._place(children, ends)

    def _place(self, children, ends):
        size = 2 * (len(children) + len(self.codes) + 2)
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        used = np.zeros(size, dtype=bool)
        used[0] = True
        where = [0] * len(children)
        # places up to the number of codes are not within every node's reach;
        # behind them, no free place lies before `start`
        start = len(self.codes) + 1
        hints: dict[int, int] = {}  # by number of children: where the last such node fitted
        # wide nodes first: narrow ones fill the gaps that they leave
        for node in _breadth_first(children):
            s = where[node]
            value[s] = ends[node]
            if not children[node]:
                continue
            codes = np.array(sorted(children[node]), dtype=np.int64)
            while start < len(used) and used[start]:
                start += 1
            at, b = max(start, hints.get(len(codes), 0)), 0
            while not b:
                if at + 512 + codes[-1] + 1 >= len(used):
                    grow = len(used) + 1024
                    base, value = np.concatenate((base, np.zeros(grow, np.int64))), np.concatenate((value, np.full(grow, -1)))
                    check, used = np.concatenate((check, np.full(grow, -1))), np.concatenate((used, np.zeros(grow, bool)))
                tries = at + np.flatnonzero(~used[at:at + 512]) - codes[0]
                tries = tries[tries >= 1]
                fits = np.flatnonzero(~used[tries[:, None] + codes].any(axis=1)) if len(tries) else tries
                if len(fits):
                    b = int(tries[fits[0]])
                at += 512
            hints[len(codes)] = b + int(codes[0]) if len(codes) > 1 else 0
            base[s] = b
            used[b + codes] = True
            check[b + codes] = s
            for c in codes.tolist():
                where[children[node][c]] = b + c
        last = int(np.flatnonzero(used)[-1]) + 1
        self.base, self.check, self.value = base[:last].tolist(), check[:last].tolist(), value[:last].tolist()


def _breadth_first(children: list[dict[int, int]]) -> Iterator[int]:
    level = [0]
    while level:
        level.sort(key=lambda node: -len(children[node]))
        yield from level
        level = [child for node in level for child in children[node].values()]


class UnigramModel:
    """Pieces with log scores, read from a SentencePiece model file."""

    def __init__(self, data: bytes, scores: dict[str, float] | None = None):
        self.pieces, self.scores, self.types = [], [], []
        self.prefix, self.trim, charsmap = True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, _NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score if scores is None else scores.get(piece, score))
                self.types.append(kind)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.prefix = bool(v)
                    elif n == 4:
                        self.trim = bool(v)
        if charsmap:
            raise ValueError("the model has a character map; only models without one are read")
        self.unknown = next((k for k, t in enumerate(self.types) if t == _UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(self.pieces, self.types)) if t == _BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.is_byte = np.array([t == _BYTE for t in self.types], dtype=bool)
        self.shown = [" ⁇ " if t == _UNKNOWN else "" if t == _CONTROL else p for p, t in zip(self.pieces, self.types)]
        whole = [(p, k) for k, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (_NORMAL, _USER) and p]
        self.trie = DoubleArray(whole)
        self.low = min((s for s, t in zip(self.scores, self.types) if t == _NORMAL), default=0.0) - 10.0
        letters = "".join(re.escape(c) for c in self.trie.codes if c != MARK)
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in whole)
        self.units = re.compile(r"(?s).+" if self.crossing or not letters else f"(?s){MARK}+[{letters}]*|[{letters}]+|.")
        # the same tables as arrays, and the bytes that each piece shows when decoded
        self._nodes = [np.array(x, dtype=np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)]
        self._piece_scores = np.array(self.scores, dtype=np.float64)
        self._code_of = np.zeros(0x110000, dtype=np.int32)
        for c, k in self.trie.codes.items():
            self._code_of[ord(c)] = k
        # a byte below 128 is a character by itself; the others need a look at their neighbours
        shown = [bytes([self.byte_of[k]]) if self.byte_of.get(k, 128) < 128 else p.replace(MARK, " ").encode("utf-8") for k, p in enumerate(self.shown)]
        self.is_high = np.array([self.byte_of.get(k, 0) >= 128 for k in range(len(self.pieces))], dtype=bool)
        self._shown_at = np.cumsum([0] + [len(b) for b in shown])
        self._shown_bytes = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self._marked = np.array([p.startswith(MARK) for p in self.shown], dtype=bool)

    def _unit(self, unit: str) -> list[int]:
        """Pieces of the best path; of equal paths the one found first, from the left."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        scores, low = self.scores, self.low
        find = self.trie.codes.get
        codes = [find(c, 0) for c in unit]
        n, size = len(codes), len(check)
        best = [-math.inf] * (n + 1)
        came, through = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, s, end = best[i], 0, i
            single = False
            while end < n:
                t = base[s] + codes[end]
                if t >= size or check[t] != s or not codes[end]:
                    break
                s = t
                end += 1
                piece = value[s]
                if piece >= 0:
                    score = here + scores[piece]
                    if score > best[end]:
                        best[end], came[end], through[end] = score, i, piece
                    if end == i + 1:
                        single = True
            if not single and here + low > best[i + 1]:
                best[i + 1], came[i + 1], through[i + 1] = here + low, i, -1
        path, at = [], n
        while at:
            piece, at = through[at], came[at]
            path.append((at, piece))
        out = []
        for at, piece in reversed(path):
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in unit[at].encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def _solve_alike(self, units: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_unit`` for many units of one length: (pieces from the last to the first
        with -2 behind them, their numbers, units that need unknown pieces)."""
        base, check, value = self._nodes
        m = len(units)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(m, length)
        codes = self._code_of[points]
        best = np.full((length + 1, m), -np.inf)
        came, through = np.zeros((length + 1, m), dtype=np.int32), np.full((length + 1, m), -1, dtype=np.int32)
        best[0] = 0.0
        for i in range(length):
            rows = np.flatnonzero(best[i] > -np.inf)
            state = np.zeros(len(rows), dtype=np.int32)
            single = np.zeros(m, dtype=bool)
            reached = rows
            for end in range(i, length):
                code = codes[rows, end]
                to = base[state] + code
                ok = (code > 0) & (to < len(check))
                ok &= check[np.where(ok, to, 0)] == state
                rows, state = rows[ok], to[ok]
                if not len(rows):
                    break
                piece = value[state]
                whole = piece >= 0
                at, piece = rows[whole], piece[whole]
                if end == i:
                    single[at] = True
                score = best[i, at] + self._piece_scores[piece]
                better = score > best[end + 1, at]
                at, piece = at[better], piece[better]
                best[end + 1, at], came[end + 1, at], through[end + 1, at] = score[better], i, piece
            at = reached[~single[reached]]
            at = at[best[i, at] + self.low > best[i + 1, at]]
            best[i + 1, at], came[i + 1, at], through[i + 1, at] = best[i, at] + self.low, i, -1
        place, every = np.full(m, length, dtype=np.int32), np.arange(m)
        path, number, unknown = [], np.zeros(m, dtype=np.int64), np.zeros(m, dtype=bool)
        while True:
            going = place > 0
            if not going.any():
                break
            piece = np.where(going, through[place, every], -2)
            unknown |= piece == -1
            number += going
            path.append(piece)
            place = np.where(going, came[place, every], 0)
        return np.array(path, dtype=np.int32).reshape(-1, m), number, unknown

    def _solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of units one after another, and where each unit's begin."""
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        order = np.argsort(lengths, kind="stable")
        counts = np.zeros(len(units), dtype=np.int64)
        parts, alone = [], []
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            length = int(lengths[group[0]]) if len(group) else 0
            for lo in range(0, len(group), _UNITS):
                some = group[lo:lo + _UNITS]
                if length > _LONG:
                    alone.extend(some.tolist())
                    continue
                path, number, unknown = self._solve_alike([units[k] for k in some.tolist()], length)
                alone.extend(some[unknown].tolist())
                some, path, number = some[~unknown], path[:, ~unknown], number[~unknown]
                counts[some] = number
                pieces = path.T[:, ::-1].ravel()
                parts.append((some, pieces[pieces >= 0], number))
        single = {k: np.array(self._unit(units[k]), dtype=np.int32) for k in alone}
        for k, ids in single.items():
            counts[k] = len(ids)
        starts = np.concatenate(([0], np.cumsum(counts)))
        out = np.zeros(starts[-1], dtype=np.int32)
        for some, pieces, number in parts:
            begin = np.concatenate(([0], np.cumsum(number)))[:-1]
            out[np.arange(len(pieces)) + np.repeat(starts[some] - begin, number)] = pieces
        for k, ids in single.items():
            out[starts[k]:starts[k + 1]] = ids
        return out, starts

    def _words_of(self, text: str) -> list[str]:
        """A text as runs that no unit reaches over: its words with the marker before
        them where each has one marker, else its units."""
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        first = MARK if self.prefix else ""
        if self.crossing or "  " in text or MARK in text or (first and text[0] == " "):
            return self.units.findall(first + text.replace(" ", MARK))
        return (first + text.replace(" ", " " + MARK)).split(" ")

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Texts of some four million characters (or one longer
        text) are held as words at a time; each different word is cut into units
        once, and each different unit is solved once."""
        at = 0
        while at < len(texts):
            words = _numbers()
            places, size = [], 0
            while at < len(texts) and (not size or size + len(texts[at]) <= _TOGETHER):
                size += len(texts[at]) + 1
                mine = self._words_of(texts[at])
                places.append(np.array(list(map(words.__getitem__, mine)), dtype=np.int32))
                at += 1
            cut = list(map(self.units.findall, words))
            units = _numbers()
            used = np.array(list(map(units.__getitem__, chain.from_iterable(cut))), dtype=np.int64)
            pieces, counts = _joined(*self._solve(list(units)), used)
            # pieces of a word: those of its units
            ends = np.cumsum([0, *map(len, cut)])
            starts = np.concatenate(([0], np.cumsum(counts)))[ends]
            for place in places:
                yield _joined(pieces, starts, place)[0]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text])).tolist()

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of rows of ids (``ids[bounds[r]:bounds[r + 1]]``): the pieces'
        bytes one after another. Rows with bytes above 127 go through ``decode``."""
        length = np.diff(self._shown_at)[ids]
        ends = np.concatenate(([0], np.cumsum(length)))
        place = np.arange(ends[-1]) + np.repeat(self._shown_at[ids] - ends[:-1], length)
        data, offsets = self._shown_bytes[place], ends[bounds]
        filled = np.flatnonzero(bounds[1:] > bounds[:-1])
        begin = offsets[:-1].copy()
        if self.prefix:         # the marker that encoding put there
            begin[filled] += self._marked[ids[bounds[filled]]]
        odd = np.zeros(len(bounds) - 1, dtype=bool)
        odd[np.searchsorted(bounds, np.flatnonzero(self.is_high[ids]), side="right") - 1] = True
        whole = data.tobytes()
        return pa.array([self.decode(ids[bounds[r]:bounds[r + 1]]) if odd[r] else whole[begin[r]:offsets[r + 1]].decode("utf-8")
                         for r in range(len(odd))], pa.string())

    def decode(self, ids) -> str:
        """Bytes that are no valid UTF-8 become U+FFFD, an unknown piece `` ⁇ ``."""
        ids = np.asarray(ids, dtype=np.int64)
        shown = self.shown.__getitem__
        is_byte = self.is_byte[ids]
        if not is_byte.any():
            parts = list(map(shown, ids.tolist()))
        else:  # runs of bytes and of other pieces take turns
            parts = []
            edges = np.flatnonzero(np.diff(is_byte)) + 1
            for run in np.split(ids, edges):
                if self.is_byte[run[0]]:
                    parts.append(bytes(self.byte_of[k] for k in run.tolist()).decode("utf-8", "replace"))
                else:
                    parts.extend(map(shown, run.tolist()))
        text = "".join(parts)
        if self.prefix and text.startswith(MARK):  # the marker that encoding put there
            text = text[1:]
        return text.replace(MARK, " ")


def _numbers() -> defaultdict:
    """Numbers for keys in the order in which they are first asked for."""
    return defaultdict(count().__next__)


def _joined(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows (``values[starts[r]:starts[r + 1]]``) one after another, and how many each has."""
    begin, size = starts[rows], starts[rows + 1] - starts[rows]
    return values[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)], size


def read_model(path: str) -> UnigramModel:
    with open(path, "rb") as f:
        return UnigramModel(f.read())


def public_model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class SentencePieces:
    """Encoding and decoding columns with one model.

    Null texts give null ids, empty texts no ids, null ids a null text. Texts of
    any length are taken whole. Decoding an encoded text returns it, but for
    markers (U+2581) in the text itself, which come back as spaces."""

    def __init__(self, spark: SparkSession, model: UnigramModel):
        ship_package(spark)
        self.model = spark.sparkContext.broadcast(model)

    def encode(self, text: Column) -> Column:
        model = self.model

        @F.arrow_udf("array<int>")
        def encoded(column: pa.Array) -> pa.Array:
            own = model.value
            missing = column.is_null()
            texts = [x.as_py() if x.is_valid else "" for x in column]
            out = list(own.encode_many(texts))
            ends = np.cumsum([0] + [len(x) for x in out]).astype(np.int32)
            values = pa.array(np.concatenate(out) if out else np.zeros(0, dtype=np.int32))
            return pa.ListArray.from_arrays(pa.array(ends), values, mask=missing)

        return encoded(text)

    def decode(self, ids: Column) -> Column:
        model = self.model

        @F.arrow_udf("string")
        def decoded(column: pa.Array) -> pa.Array:
            own = model.value
            values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = []
            begin = 0
            while begin < len(column):      # rows of some million ids at once
                end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + (1 << 20), side="right")) - 1)
                texts.append(own.decode_many(values[bounds[begin]:bounds[end]], (bounds[begin:end + 1] - bounds[begin]).astype(np.int64)))
                begin = end
            whole = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
            return pa.compute.if_else(column.is_valid(), whole, pa.scalar(None, pa.string()))

        return decoded(ids)


def encode_documents(docs: DataFrame, model_path: str | None = None, text_col: str = "text",
                     ids_col: str = "piece_ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of its texts (and, on demand, the text decoded from
    them); columns of these names are refused. Repeated rows get equal ids; an
    empty table gives an empty result."""
    added = [ids_col] + ([decoded_col] if decoded_col else [])
    if set(added) & set(docs.columns):
        raise ValueError(f"docs already has one of the columns {added}")
    pieces = SentencePieces(docs.sparkSession, read_model(model_path or public_model_path()))
    out = docs.withColumn(ids_col, pieces.encode(F.col(f"`{text_col}`").cast("string")))
    return out.withColumn(decoded_col, pieces.decode(F.col(ids_col))) if decoded_col else out
