"""LM scoring: a hierarchical Pitman-Yor bigram model of all documents.

Restaurants: one per context (every word of the training texts, and the start of
a text), and the root, their parent, whose base is uniform over the training
words and one unknown word. Seating follows the Chinese restaurant process: a
customer of a context that opens a table sends one customer to the root. A
context that training has not seen gives all its weight to the root.

How the corpus is laid out:

1. Words of at least 1/2048 of the training tokens ("heavy", at most 2048) are
   found by counting all words, map-side first: the same ones however the rows
   are split into tasks. Everything about pairs of them fits into a table of
   fixed size; pairs are counted with map-side sums.
2. All other tokens (word, document, context) travel once, in compressed lists,
   to the cell group of their *word*: a word's counts in all contexts and in
   the root are then in one place. A heavy word after a light context goes to
   the group of the *context* instead, so neither a word nor a context is heavier
   than 1/2048 of all tokens there; the number of groups follows the number of
   tokens. Lists travel packed, as compressed bytes. They are written in waves
   of groups, and counted and scored wave by wave, so that only a wave's share
   of the tokens is in a shuffle at a time; a scored wave is deleted.
3. Gibbs sweeps run over written cells, one task per group of cells: customers
   drawn at random leave their tables and sit down again, as many moves in a
   sweep as a cell has customers (in cells of more than 64 customers, a 64th of
   them at a time), given the tables of their own restaurant (its total from
   the sweep before) and the root's predictive probability. Cells of one
   customer have one table and need no sampling.
4. Between sweeps the tables of each restaurant are summed up: for the heavy
   contexts in one small table, for the light ones by a shuffle of lists from the
   cell groups to groups of contexts and back. Heavy words' tables after light
   contexts are summed up too; their customers enter the root in the next sweep,
   and those cells see the root as it was before the sweep.
5. Scoring averages the predictive probabilities of the kept states. The
   tokens of the lists are scored in their cell groups, the heavy words after
   heavy contexts beside their document, and both are summed per document:
   those of the lists first within a wave.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablelens.llm import words as W
from tablelens.llm.stage import Steps

#: Words of at least this share are heavy: what concerns two of them is kept in
#: tables of fixed size (all words are contexts, heavy or not).
SHARE = 2048
GROUP_TOKENS = 3 << 19
END = np.uint64(0x1F83D9ABFB41BD6B)
_FLUSH_TOKENS = 1 << 20
#: The cell groups are dealt into this many waves; a shuffle of tokens holds one of them.
WAVES = 4
_ROUNDS = 64  # moves of a cell in a sweep that are made one after another
_NONE = 0  # stands for the root among the numbers of contexts
_START = 1  # context number of the start of a text; heavy words follow from 2
_LIGHT = np.uint64(1 << 63)  # set in the hash of a light word as context: below 0 as a signed number


def held_out(doc_id) -> bool:
    """Documents that nothing is learnt from: crc32 of the id as text divides
    by ten; a row without id is one of them."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def _documents(batches: Iterator[pa.RecordBatch]):
    """(row numbers, ids, held flags, word hashes with ends, first token of each row)."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        data, offsets = W.column_bytes(batch.column(1))
        for i, j in W.text_groups(offsets):
            h, _, _, first = W.words_of_rows(data, offsets, i, j, lower=True)
            at = first[1:]
            tokens = np.insert(h, at, END)
            first = first + np.arange(len(first))
            yield ids[i:j], np.array([held_out(x) for x in ids[i:j]]), tokens, first


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every training word of a task with its count (summed up over the tasks
    afterwards, so that totals do not depend on how the rows are split)."""
    words, times = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    parts, size = [], 0

    def merge():
        w = np.concatenate([words, *(p[0] for p in parts)])
        c = np.concatenate([times, *(p[1] for p in parts)])
        order = np.argsort(w, kind="stable")
        w, c = w[order], c[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(len(w), 1), dtype=bool), w[1:] != w[:-1])))
        return w[first], np.add.reduceat(c, first) if len(first) else c

    for _, held, tokens, first in _documents(batches):
        tokens = tokens[np.repeat(~held, np.diff(first))]
        parts.append(np.unique(tokens, return_counts=True))
        size += len(parts[-1][0])
        if size > max(1 << 20, len(words)):
            words, times = merge()
            parts, size = [], 0
    words, times = merge()
    for k in range(0, len(words), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(words[k:k + (1 << 16)].view(np.int64)), pa.array(times[k:k + (1 << 16)])],
                                         names=["word", "times"])


_ZSTD = pa.Codec("zstd", compression_level=1)


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, which Spark moves as a whole: in the narrowest
    type that holds them, first bytes first."""
    values = np.asarray(values)
    if values.dtype.kind == "i" and (not len(values) or values.min() >= 0):
        values = values.astype(np.min_scalar_type(values.max() if len(values) else 0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return values.dtype.str.encode() + len(values).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def _length(packed: pa.BinaryScalar) -> int:
    return int.from_bytes(memoryview(packed.as_buffer())[3:11], "little")


def _unpack(packed: pa.BinaryScalar, kind=np.int64) -> np.ndarray:
    data = memoryview(packed.as_buffer())
    stored, n = np.dtype(bytes(data[:3]).decode()), _length(packed)
    if not n:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(_ZSTD.decompress(data[11:], n * stored.itemsize), dtype=np.uint8).reshape(stored.itemsize, n)
    return np.ascontiguousarray(planes.T).view(stored).reshape(n).astype(kind, copy=False)


#: ``wave`` of a list: its group's, or one of its own for documents and for counts of heavy pairs.
_LISTS = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()),
                    ("times", pa.binary()), ("doc", pa.binary()), ("context", pa.binary()), ("ids", pa.list_(pa.int64())),
                    ("held", pa.list_(pa.bool_())), ("tokens", pa.list_(pa.int32())), ("wave", pa.int32())])
_LISTS_SQL = ("kind byte, part int, block long, words binary, times binary, doc binary, "
              "context binary, ids array<long>, held array<boolean>, tokens array<int>, wave int")
_TOKENS, _COUNTS, _DOCS, _FAR, _SHARES = range(5)
_WAVE_OF_DOCS, _WAVE_OF_COUNTS = -1, -2


def _row(**values) -> pa.RecordBatch:
    arrays = []
    for f in _LISTS:
        v = values.get(f.name)
        if pa.types.is_binary(f.type):
            arrays.append(pa.array([None if v is None else _pack(v)], f.type))
        elif pa.types.is_list(f.type):
            if v is None:
                arrays.append(pa.array([None], f.type))
            else:
                v = pa.array(v, f.type.value_type)
                arrays.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
        else:
            arrays.append(pa.array([v], f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_LISTS)


def _distribute(heavy: np.ndarray, groups: int, waves: int):
    """Tokens to their cell groups, in lists; per block of documents a row with
    its documents and, in ``context``, the pairs of heavy words. Heavy words after
    light contexts go by context: ``words`` then has contexts, ``context`` the
    numbers of the words."""
    def place(words: np.ndarray) -> np.ndarray:
        return (W.mix(words ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(groups)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        k = len(heavy) + 2
        pairs = np.zeros((k, k), dtype=np.int64)
        held_rows: list = []
        size = 0
        for ids, held, tokens, first in _documents(batches):
            held_rows.append((ids, held, tokens, first))
            size += len(tokens)
            if size >= _FLUSH_TOKENS:
                yield from flush(held_rows, block, pairs)
                held_rows, size, block = [], 0, block + 1
                pa.default_memory_pool().release_unused()
        if held_rows:
            yield from flush(held_rows, block, pairs)
        there = pairs > 0
        there[_START, 2:] = True  # its group hears of a heavy word in any case
        u, w = np.nonzero(there)
        if len(u):
            words = heavy[w - 2]
            order = np.lexsort((u, words, place(words)))
            u, w, words = u[order], w[order], words[order]
            part = place(words)
            for p in np.unique(part):
                at = part == p
                own, times = np.unique(words[at], return_counts=True)
                yield _row(kind=_COUNTS, part=int(p), block=-1, words=own.view(np.int64), times=times,
                           doc=pairs[u[at], w[at]], context=u[at], wave=_WAVE_OF_COUNTS)

    def flush(rows, block, pairs):
        ids = [x for r in rows for x in r[0]]
        held = np.concatenate([r[1] for r in rows])
        tokens = np.concatenate([r[2] for r in rows])
        lengths = np.concatenate([np.diff(r[3]) for r in rows])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        doc = np.repeat(np.arange(len(ids)), lengths)
        number = np.zeros(len(tokens), dtype=np.int64)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
            number[heavy[at] == tokens] = at[heavy[at] == tokens] + 2
        before = np.empty(len(tokens), dtype=np.int64)
        before[1:] = np.where(number[:-1] > 0, number[:-1], (tokens[:-1] | _LIGHT).view(np.int64))
        before[starts] = _START
        is_heavy, after_light = number > 0, before < 0
        k = len(heavy) + 2
        both = is_heavy & ~after_light
        code = before[both] * k + number[both]
        trained = ~held[doc[both]]
        pairs += np.bincount(code[trained], minlength=k * k).reshape(k, k)
        per_doc = np.bincount(doc[both], minlength=len(ids))
        yield _row(kind=_DOCS, part=int(block % groups), block=block, ids=ids, held=held, tokens=lengths,
                   times=per_doc, context=code, wave=_WAVE_OF_DOCS)
        doc = doc * 2 + held[doc]
        rest, far = np.flatnonzero(~is_heavy), np.flatnonzero(is_heavy & after_light)
        yield from spread(_TOKENS, block, tokens[rest].view(np.int64), doc[rest], before[rest])
        yield from spread(_FAR, block, before[far], doc[far], number[far])

    def spread(kind, block, keys, doc, beside):
        part = place(keys.view(np.uint64))
        order = np.lexsort((keys, part))
        keys, doc, beside, part = keys[order], doc[order], beside[order], part[order]
        edge = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.concatenate(([0], edge)), np.concatenate((edge, [len(part)]))):
            if b > a:
                own, times = np.unique(keys[a:b], return_counts=True)
                yield _row(kind=kind, part=int(part[a]), block=block, words=own, times=times, doc=doc[a:b], context=beside[a:b],
                           wave=int(part[a]) % waves)

    return send


def _flat(column, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *(_unpack(x, kind) for x in column)])


def _tokens_of(table: pa.Table, doc=np.int32):
    """(distinct words, index of each token's word, contexts, docs) of list rows."""
    words = _flat(table.column("words"))
    types = np.unique(words)
    index = np.repeat(np.searchsorted(types, words).astype(np.int32), _flat(table.column("times")))
    return types, index, _flat(table.column("context")), _flat(table.column("doc"), doc)


def _kinds(table: pa.Table, *kinds: int) -> list[pa.Table]:
    kind = np.asarray(table.column("kind"))
    return [table.filter(pa.array(kind == x)) for x in kinds]


def _numbered(context: np.ndarray, light: np.ndarray, k: int) -> np.ndarray:
    """Numbers of contexts: of those below 0 their places in ``light``, from ``k``."""
    out = context.copy()
    below = context < 0
    out[below] = k + np.searchsorted(light, context[below])
    return out


def _homes(words: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, ascending, and numbers) of the heavy words among a group's words."""
    keys = heavy.view(np.int64)
    at = np.searchsorted(words, keys)
    here = np.flatnonzero(at < len(words))
    here = here[words[at[here]] == keys[here]]
    here = here[np.argsort(at[here])]
    return at[here], here + 2


class _Cells:
    """Counts of a cell group: words, and (word, context, customers) cells.
    Contexts from ``k`` are the group's ``light`` ones (those of held-out texts
    too); words from ``len(words)`` are heavy ones after light contexts, by number."""

    def __init__(self, table: pa.Table, k: int, heavy: np.ndarray, times: np.ndarray):
        tokens, counts, far = _kinds(table, _TOKENS, _COUNTS, _FAR)
        types, index, context, doc = _tokens_of(tokens)
        keys, far_index, far_word, far_doc = _tokens_of(far)
        self.light = np.unique(np.concatenate((context[context < 0], keys)))
        size = k + len(self.light)
        train = (doc & 1) == 0
        cell, customers = np.unique(index[train].astype(np.int64) * size + _numbered(context[train], self.light, k),
                                    return_counts=True)
        train = (far_doc & 1) == 0
        far_context = k + np.searchsorted(self.light, keys)[far_index[train]]
        far_cell, far_customers = np.unique(far_word[train] * size + far_context, return_counts=True)
        # pairs of heavy words have come as counts; they are none of the others
        more, index, context, n = _tokens_of(counts, np.int64)
        pair, back = np.unique(index.astype(np.int64) * size + context, return_inverse=True)
        n = np.bincount(back, weights=n, minlength=len(pair)).astype(np.int64)
        pair, n = pair[n > 0], n[n > 0]
        words = np.concatenate((types, more))
        word = np.concatenate((cell // size, pair // size + len(types)))
        # words in order, without those of held-out texts alone
        total = np.bincount(word, weights=np.concatenate((customers, n)), minlength=len(words)).astype(np.int64)
        if len(more):
            total[len(types):] = times[np.searchsorted(heavy, more.view(np.uint64))]
        order = np.argsort(words, kind="stable")
        order = order[total[order] > 0]
        place = np.zeros(len(words), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.words, self.total = words[order], total[order]
        self.word = np.concatenate((place[word], len(order) + far_cell // size))
        self.context = np.concatenate((cell % size, pair % size, far_cell % size))
        self.customers = np.concatenate((customers, n, far_customers))


class Seating:
    """Tables of many cells at once: ``owner`` (cell, ascending) and ``size`` of
    each; customers and tables of a cell are kept up to date beside them."""

    def __init__(self, cells: int, owner: np.ndarray, size: np.ndarray):
        if len(owner) and (owner[1:] < owner[:-1]).any():
            order = np.argsort(owner, kind="stable")
            owner, size = owner[order], size[order]
        self.cells, self.owner, self.size = cells, owner, size
        self._count = np.bincount(owner, weights=size, minlength=cells).astype(np.int64)
        self._tables = np.bincount(owner[size > 0], minlength=cells)

    def tables(self) -> np.ndarray:
        return self._tables.copy()

    def customers(self) -> np.ndarray:
        return self._count.copy()

    def _seats(self, places: int):
        """The tables of places in the row of all customers: by a list of every
        customer's table where there are many places, else by search."""
        upto = np.cumsum(self.size)
        if 16 * places > (upto[-1] if len(upto) else 0):
            seat = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
            return lambda at: seat[at]
        return lambda at: np.searchsorted(upto, at, side="right")

    def _open(self, cells: np.ndarray) -> None:
        """A table of one customer for each entry of ``cells``, after the cell's
        others; empty tables go."""
        alive = self.size > 0
        owner, size = self.owner[alive], self.size[alive]
        at = np.searchsorted(owner, cells, side="right")
        self.owner, self.size = np.insert(owner, at, cells), np.insert(size, at, 1)

    def _some_of(self, cells: np.ndarray, k: np.ndarray, random) -> np.ndarray:
        """Per table, how many of ``k`` random customers of each cell sit there."""
        count = self._count
        begin = np.concatenate(([0], np.cumsum(count)))  # of each cell in the row of all customers
        rest = 2 * k > count[cells]  # fewer stay than are picked: draw those
        want = np.where(rest, count[cells] - k, k)
        left = want
        picked = np.zeros(0, dtype=np.int64)
        while left.any():
            c = np.repeat(cells, left)
            new = begin[c] + (random.random_sample(len(c)) * count[c]).astype(np.int64)
            if want.max() <= 1 and (cells[1:] > cells[:-1]).all():  # one of each cell: different ones, in order
                picked = new
                break
            picked = np.concatenate((picked, new))
            picked.sort()
            picked = picked[np.concatenate(([True], picked[1:] != picked[:-1]))]
            left = want - (np.searchsorted(picked, begin[cells + 1]) - np.searchsorted(picked, begin[cells]))
        out = np.bincount(self._seats(len(picked))(picked), minlength=len(self.size))
        if rest.any():
            turn = np.zeros(self.cells, dtype=bool)
            turn[cells[rest]] = True
            turn = turn[self.owner]
            out[turn] = self.size[turn] - out[turn]
        return out

    def leave_many(self, cells: np.ndarray, k: np.ndarray, random) -> np.ndarray:
        """``k`` random customers of each cell (no cell twice) leave; tables closed per cell (of all)."""
        if len(cells) == 0:
            return np.zeros(self.cells, dtype=np.int64)
        gone = self._some_of(cells, k, random)
        self.size = self.size - gone
        closed = np.bincount(self.owner[(self.size == 0) & (gone > 0)], minlength=self.cells)
        self._count[cells] -= k
        self._tables -= closed
        return closed

    def sit_many(self, cells: np.ndarray, k: np.ndarray, new_weight: np.ndarray, discount: np.ndarray, random,
                 closed: np.ndarray | None = None) -> np.ndarray:
        """``k`` customers join each cell (no cell twice), each as if the others of
        its batch were seated; tables opened per cell (of all). ``closed``: tables
        that the batch left empty."""
        if len(cells) == 0:
            return np.zeros(self.cells, dtype=np.int64)
        count, tables = self._count[cells], self._tables[cells]
        empty = count == 0
        if closed is not None:
            tables = tables + np.where(k > 1, closed[cells], 0)
        old = np.where(empty, 0.0, np.maximum(count + k - 1 - discount * tables, 0.0))
        p = new_weight / (old + new_weight)
        if (k == 1).all():  # the same draws, in less time
            u = random.random_sample(len(k))
            opened = np.where(p <= 0.5, u > 1 - p, u <= p).astype(np.int64)
        else:
            opened = random.binomial(k, p)
        c, d = np.repeat(cells, k - opened), np.repeat(discount, k - opened)
        joins = [np.zeros(0, dtype=np.int64)]
        if len(c):
            begin, seats = np.cumsum(self._count)[c] - self._count[c], self._seats(len(c))
            n = self._count[c]
        while len(c):  # a table in proportion to size - discount, by rejection
            t = seats(begin + (random.random_sample(len(c)) * n).astype(np.int64))
            size = self.size[t]
            good = random.random_sample(len(c)) * size < size - d
            joins.append(t[good])
            bad = np.flatnonzero(~good)
            c, d, begin, n = c[bad], d[bad], begin[bad], n[bad]
        self.size = self.size + np.bincount(np.concatenate(joins), minlength=len(self.size))
        out = np.zeros(self.cells, dtype=np.int64)
        out[cells] = opened
        self._count[cells] += k
        self._tables += out
        if opened.any():
            self._open(np.repeat(cells, opened))
        return out

    def take(self, cells: np.ndarray) -> Seating:
        """The tables of some cells (ascending), numbered from 0."""
        number = np.full(self.cells, -1, dtype=np.int64)
        number[cells] = np.arange(len(cells))
        number = number[self.owner]
        mine = (number >= 0) & (self.size > 0)
        return Seating(len(cells), number[mine], self.size[mine])

    def put(self, cells: np.ndarray, taken: Seating) -> None:
        other = np.ones(self.cells, dtype=bool)
        other[cells] = False
        other, alive = other[self.owner], taken.size > 0
        owner = np.concatenate((self.owner[other], cells[taken.owner[alive]]))
        size = np.concatenate((self.size[other], taken.size[alive]))
        order = np.argsort(owner, kind="stable")
        self.owner, self.size = owner[order], size[order]
        self._count[cells], self._tables[cells] = taken._count, taken._tables


def _classes(customers: np.ndarray, draws: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(cells, moves of each in a sweep, rounds) of cells of several customers:
    every customer once, ``draws`` moves at least."""
    moves = np.where(customers > 1, np.maximum(customers, draws), 0)
    low, high = 0, max(draws, 2)
    while True:
        last = high >= _ROUNDS
        cells = np.flatnonzero((moves > low) & ((moves <= high) | last))
        if len(cells):
            yield cells, moves[cells], min(high, max(_ROUNDS, draws))
        if last:
            return
        low, high = high, 2 * high


def _round_moves(moves: np.ndarray, r: int, rounds: int, customers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the cells that move in round r, number of their customers that move)."""
    k = np.minimum(moves * (r + 1) // rounds - moves * r // rounds, customers)
    at = np.flatnonzero(k)
    return at, k[at]


def sweep_seats(cells: Seating, word: np.ndarray, room: np.ndarray, root: Seating, predictive, discount: float,
                base: float, root_discount: float, draws: int, random) -> None:
    """Every customer of the cells, then every customer of the root, leaves and
    sits down again once (``draws`` moves at least of a cell). ``word``: root
    cell of each cell; ``predictive``: the root's, from customers and tables."""
    for own, moves, rounds in _classes(cells.customers(), draws):
        words, at = np.unique(word[own], return_inverse=True)
        c, r = cells.take(own), root.take(words)
        every = np.arange(len(words))
        for i in range(rounds):
            some, k = _round_moves(moves, i, rounds, c.customers())
            closed = c.leave_many(some, k, random)
            n = np.bincount(at, weights=closed, minlength=len(words)).astype(np.int64)
            r.leave_many(every[n > 0], n[n > 0], random)
            p = predictive(r.customers(), r.tables())
            opened = c.sit_many(some, k, room[own[some]] * p[at[some]], np.full(len(some), discount), random, closed)
            n = np.bincount(at, weights=opened, minlength=len(words)).astype(np.int64)
            w = every[n > 0]
            r.sit_many(w, n[w], np.full(len(w), base), np.full(len(w), root_discount), random)
        cells.put(own, c)
        root.put(words, r)
    for own, moves, rounds in _classes(root.customers(), draws):
        r = root.take(own)
        for i in range(rounds):
            some, k = _round_moves(moves, i, rounds, r.customers())
            closed = r.leave_many(some, k, random)
            r.sit_many(some, k, np.full(len(some), base), np.full(len(some), root_discount), random, closed)
        root.put(own, r)


def sweep_far(cells: Seating, room: np.ndarray, p: np.ndarray, discount: float, draws: int, random) -> None:
    """The same for cells whose root is seated in another group; ``p``: the root's
    predictive probability for each cell, as it was before the sweep."""
    for own, moves, rounds in _classes(cells.customers(), draws):
        c = cells.take(own)
        new = room[own] * p[own]
        for i in range(rounds):
            some, k = _round_moves(moves, i, rounds, c.customers())
            closed = c.leave_many(some, k, random)
            c.sit_many(some, k, new[some], np.full(len(some), discount), random, closed)
        cells.put(own, c)


#: A cell group between sweeps. ``light``: the light contexts of its cells, with
#: the group's own tables now (``light_tables``) and in each kept state (``kept``,
#: by context); ``seated``: customers of its heavy words from other groups' cells.
_STATE_COLUMNS = [("part", "int"), ("words", "ints"), ("cell_word", "ints"), ("cell_context", "ints"),
                  ("cell_owner", "ints"), ("cell_size", "ints"), ("root_owner", "ints"),
                  ("root_size", "ints"), ("root_p", "floats"), ("cell_p", "floats"),
                  ("context", "array<int>"), ("tables", "array<long>"), ("customers", "array<long>"),
                  ("light", "ints"), ("light_tables", "ints"), ("kept", "ints"),
                  ("seated", "ints"), ("ones", "long"), ("twos", "long"), ("root_ones", "long"), ("root_twos", "long")]
#: What the first state has besides: the number of its words, and every light context
#: of the group's tokens, with (cells of one customer, customers) of each.
_FIRST_COLUMNS = [*_STATE_COLUMNS, ("types", "long"), ("every", "ints"), ("every_counts", "ints")]
#: (``ints`` and ``floats``: packed)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
          "ints": pa.binary(), "floats": pa.binary()}
_PACKED = {"ints": np.int64, "floats": np.float32}


def _sql(columns) -> str:
    return ", ".join(f"{n} {'binary' if t in _PACKED else t}" for n, t in columns)


def _state_row(values: dict, columns=_STATE_COLUMNS) -> pa.Table:
    arrays = []
    for name, t in columns:
        v, kind = values[name], _ARROW[t]
        if t in _PACKED:
            arrays.append(pa.array([_pack(np.asarray(v).astype(_PACKED[t]))], kind))
        elif pa.types.is_list(kind):
            v = pa.array(np.asarray(v).astype(kind.value_type.to_pandas_dtype()))
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
        else:
            arrays.append(pa.array([int(v)], kind))
    return pa.Table.from_arrays(arrays, names=[n for n, _ in columns])


def _totals(tables: np.ndarray, customers: np.ndarray) -> dict:
    """This group's share of the sums that every group hears: by number of a heavy
    context (_NONE: the root); from k on, by heavy word, its tables in the root;
    from 2k on, its tables after light contexts."""
    at = np.flatnonzero(customers)
    return {"context": at, "tables": tables[at], "customers": customers[at]}


def _root_totals(k: int, homes: tuple[np.ndarray, np.ndarray], tables: np.ndarray, customers: np.ndarray,
                 root_tables: np.ndarray, root_customers: np.ndarray) -> None:
    at, number = homes
    tables[_NONE], customers[_NONE] = root_tables.sum(), root_customers.sum()
    tables[k + number], customers[k + number] = root_tables[at], root_customers[at]


def _first_state(k: int, heavy: np.ndarray, times: np.ndarray):
    """One table per cell; cells of one customer stay so and are summed up."""
    def make(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        part = table.column("part")[0].as_py()
        cells = _Cells(table, k, heavy, times)
        n = len(cells.words)
        here, several, own = cells.word < n, cells.customers > 1, cells.context < k
        # customers of the root: a table of each cell (those of far cells come with the first sweep)
        root = np.bincount(cells.word[here], minlength=n)
        known = np.arange(n)
        homes = _homes(cells.words, heavy)
        number = np.where(own, cells.context, 2 * k + cells.word - n)
        number, customers = number[own | ~here], cells.customers[own | ~here]
        sums = np.bincount(number, minlength=3 * k), np.bincount(number, weights=customers, minlength=3 * k).astype(np.int64)
        _root_totals(k, homes, *sums, (root > 0).astype(np.int64), root)
        # light contexts: all, for the groups of contexts; those of cells to be sampled stay in the state
        every, light = len(cells.light), cells.context[~own] - k
        counts = (np.bincount(light[~several[~own]], minlength=every),
                  np.bincount(light, weights=cells.customers[~own], minlength=every))
        used, light_tables = np.unique(cells.context[several & ~own] - k, return_counts=True)
        context = cells.context[several]
        context = np.where(context < k, context, k + np.searchsorted(used, context - k))
        return _state_row({
            "part": part, "words": cells.words, "cell_word": cells.word[several], "cell_context": context,
            "cell_owner": np.arange(int(several.sum())), "cell_size": cells.customers[several],
            "root_owner": known[root > 0], "root_size": root[root > 0], "root_p": [], "cell_p": [], **_totals(*sums),
            "light": cells.light[used], "light_tables": light_tables, "kept": [], "seated": np.zeros(len(homes[0])),
            "ones": int((cells.customers == 1).sum()), "twos": int((cells.customers == 2).sum()),
            "root_ones": int((cells.total == 1).sum()), "root_twos": int((cells.total == 2).sum()),
            "types": n, "every": cells.light, "every_counts": np.column_stack(counts).reshape(-1)}, _FIRST_COLUMNS)

    return make


#: Lists of light contexts with a few numbers of each, from a cell group to a group of contexts.
_SENT = "home int, part int, contexts binary, numbers binary"


def _send(homes: int):
    """Lists of (part, light contexts ascending, numbers of each) to the groups of
    their contexts, which are ranges of the hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                contexts, numbers = (_unpack(batch.column(c)[r]) for c in (1, 2))
                if not len(contexts):
                    continue
                home = ((contexts.view(np.uint64) ^ _LIGHT) >> np.uint64(31)) * np.uint64(homes) >> np.uint64(32)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(home)) + 1, [len(home)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(cuts) - 1, batch.column(0)[r].as_py(), np.int32)),
                     _lists(cuts, contexts), _lists(cuts * (len(numbers) // len(contexts)), numbers)],
                    names=["home", "part", "contexts", "numbers"])

    return run


def _lists(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.array([_pack(values[i:j]) for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())


def _cuts(column) -> np.ndarray:
    """Ends of the lists of a column, from 0."""
    return np.concatenate(([0], np.cumsum([_length(x) for x in column], dtype=np.int64)))


def _sum_contexts(sent: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts ascending, (cells of one customer, customers) of each, place of each entry)."""
    contexts, back = np.unique(_flat(sent.column("contexts")), return_inverse=True)
    counts = _flat(sent.column("numbers")).reshape(-1, 2)
    return contexts, np.column_stack([np.bincount(back, weights=counts[:, j], minlength=len(contexts)).astype(np.int64)
                                      for j in (0, 1)]), back


def _count_contexts(sent: pa.Table) -> pa.Table:
    contexts, counts, _ = _sum_contexts(sent)
    return pa.table({"home": pa.array([sent.column("home")[0].as_py()], pa.int32()), "part": pa.array([-1], pa.int32()),
                     "contexts": _lists(np.array([0, len(contexts)]), contexts),
                     "numbers": _lists(np.array([0, 2 * len(contexts)]), counts.reshape(-1))})


def _sum_tables(counted: pa.Table, sent: pa.Table) -> pa.Table:
    """Answers to the lists of the cell groups: (tables, customers) of each context in all groups."""
    cuts = _cuts(sent.column("contexts"))
    if sent.num_rows:
        contexts, counts = _flat(counted.column("contexts")), _flat(counted.column("numbers")).reshape(-1, 2)
        at = np.searchsorted(contexts, _flat(sent.column("contexts")))
        tables = counts[:, 0] + np.bincount(at, weights=_flat(sent.column("numbers")), minlength=len(contexts)).astype(np.int64)
        numbers = np.column_stack((tables[at], counts[at, 1])).reshape(-1)
    else:
        numbers = np.zeros(0, dtype=np.int64)
    return pa.table({"home": sent.column("home").cast(pa.int32()), "part": sent.column("part").cast(pa.int32()),
                     "numbers": _lists(2 * cuts, numbers)})


def _light_tables(states: int):
    """Customers and, by kept state, the tables of every light context of a cell group's tokens."""
    def answer(asked: pa.Table, sent: pa.Table) -> pa.Table:
        contexts, counts, back = _sum_contexts(asked)
        cuts = _cuts(asked.column("contexts"))
        tables = np.repeat(counts[:, :1], states, axis=1)
        if sent.num_rows:
            at = np.searchsorted(contexts, _flat(sent.column("contexts")))
            kept = _flat(sent.column("numbers")).reshape(-1, states)
            for j in range(states):
                tables[:, j] += np.bincount(at, weights=kept[:, j], minlength=len(contexts)).astype(np.int64)
        n = asked.num_rows
        return pa.table({"part": asked.column("part").cast(pa.int32()), "kind": pa.array(np.full(n, _SHARES, np.int8)),
                         "words": asked.column("contexts"), "times": _lists(cuts, counts[back, 1]),
                         "tables": _lists(states * cuts, tables[back].reshape(-1))})

    return answer


class _Globals:
    """What a sweep knows of the other groups: totals per restaurant."""

    def __init__(self, k, tables, customers, types, discount, root_discount, strength=1.0):
        self.tables, self.customers = tables[:k], customers[:k]
        # by heavy word: tables and customers in the root, tables after light contexts
        self.word_tables, self.word_customers, self.far = tables[k:2 * k], customers[k:2 * k], tables[2 * k:].astype(np.int64)
        self.types, self.d, self.d0, self.strength = types, discount, root_discount, strength

    def root_p(self, customers, tables):
        """Predictive probability of the root (its totals are under _NONE)."""
        c, t = self.customers[_NONE], self.tables[_NONE]
        return (customers - self.d0 * tables + (self.strength + self.d0 * t) / (self.types + 1)) / (self.strength + c)

    def heavy_p(self) -> np.ndarray:
        """The root's predictive probability of the heavy words, by number."""
        return self.root_p(self.word_customers, self.word_tables)

    def unknown_p(self) -> float:
        return float(self.root_p(0.0, 0.0))

    def share(self) -> np.ndarray:
        """Weight that each context gives to its parent; 1 for no context."""
        s = (self.strength + self.d * self.tables) / (self.strength + self.customers)
        s[_NONE] = 1.0
        return s


def _sweep(g: _Globals, heavy: np.ndarray, first: bool, keep: bool, move: bool, draws: int, seed: int):
    """Optionally note the predictive probabilities of a state, then move on."""
    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        row = {}
        for n, t in _STATE_COLUMNS:
            value = state.column(n)[0]
            if t in _PACKED:
                row[n] = _unpack(value, _PACKED[t])
            else:
                row[n] = value.values.to_numpy(zero_copy_only=False) if t.startswith("array") else value.as_py()
        answers = answers.sort_by("home")
        light = _flat(answers.column("numbers")).reshape(-1, 2).astype(np.float64)
        out = _state_row(step(row, light[:, 0], light[:, 1]))
        pa.default_memory_pool().release_unused()
        return out

    def step(row: dict, light_tables: np.ndarray, light_customers: np.ndarray) -> dict:
        random = np.random.RandomState((seed * 1_000_003 + row["part"]) % (1 << 32))
        k, n = len(g.tables), len(row["words"])
        word, context = row["cell_word"].astype(np.int64), row["cell_context"].astype(np.int64)
        cells = Seating(len(word), row["cell_owner"].astype(np.int64), row["cell_size"].astype(np.int64))
        at, number = homes = _homes(row["words"], heavy)
        owner, size = row["root_owner"].astype(np.int64), row["root_size"].astype(np.int64)
        if first:  # one table each, for the customers from far cells too
            size = np.bincount(owner, weights=size, minlength=n).astype(np.int64)
            size[at] += g.far[number]
            owner, size = np.flatnonzero(size), size[size > 0]
        root = Seating(n, owner, size)
        tables, customers = np.concatenate((g.tables, light_tables)), np.concatenate((g.customers, light_customers))
        if keep:
            p = g.root_p(root.customers(), root.tables())
            own = (cells.customers() - g.d * cells.tables()) / (g.strength + customers[context])
            share = (g.strength + g.d * tables) / (g.strength + customers)
            row["root_p"] = np.concatenate((row["root_p"], p))
            row["cell_p"] = np.concatenate((row["cell_p"], own + share[context] * np.concatenate((p, g.heavy_p()))[word]))
            if len(row["light"]):
                row["kept"] = np.column_stack((row["kept"].reshape(len(row["light"]), -1), row["light_tables"])).reshape(-1)
        if move:
            base = (g.strength + g.d0 * g.tables[_NONE]) / (g.types + 1)
            if not first:  # what the far cells have sent or taken back in the sweep before
                more = g.far[number] - row["seated"]
                root.leave_many(at[more < 0], -more[more < 0], random)
                joins = at[more > 0]
                root.sit_many(joins, more[more > 0], np.full(len(joins), base), np.full(len(joins), g.d0), random)
            before = cells.tables()
            room = g.strength + g.d * tables[context]
            near, far = np.flatnonzero(word < n), np.flatnonzero(word >= n)
            here, away = cells.take(near), cells.take(far)
            sweep_seats(here, word[near], room[near], root, g.root_p, g.d, base, g.d0, draws, random)
            sweep_far(away, room[far], g.heavy_p()[word[far] - n], g.d, draws, random)
            cells.put(near, here)
            cells.put(far, away)
            alive, there = cells.size > 0, root.size > 0
            own = context < k
            row.update(cell_owner=cells.owner[alive], cell_size=cells.size[alive], root_owner=root.owner[there],
                       root_size=root.size[there], seated=g.far[number], light_tables=np.bincount(
                           context[~own] - k, weights=cells.tables()[~own], minlength=len(row["light"])))
            # this group's totals: what single cells add never changes
            sums = [np.bincount(row["context"], weights=row[x], minlength=3 * k).astype(np.int64) for x in ("tables", "customers")]
            moved = cells.tables() - before
            sums[0] += np.bincount(context[own], weights=moved[own], minlength=3 * k).astype(np.int64)
            sums[0] += np.bincount(2 * k + word[far] - n, weights=moved[far], minlength=3 * k).astype(np.int64)
            _root_totals(k, homes, *sums, root.tables(), root.customers())
            row.update(_totals(*sums))
        else:  # the last state is only read: its seats are not needed any more
            row.update({n: [] for n in ("cell_owner", "cell_size", "root_owner", "root_size", "light_tables", "seated")})
        return row

    return run


#: What a cell group adds to a block's documents, as lists: a row per block.
_SUMS = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("doc", "score", "base", "known"))])
_SUMS_SQL = "block long, doc binary, score binary, base binary, known binary"


def _sums_row(block: int, doc: np.ndarray, score: np.ndarray, base: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Sums of a block's documents, of those that ``doc`` has entries for."""
    there = np.flatnonzero(np.bincount(doc))
    values = [there, *(np.bincount(doc, weights=x)[there] for x in (score, base)),
              np.bincount(doc, weights=known)[there].round().astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([_pack(x)], pa.binary()) for x in values)],
                                      schema=_SUMS)


def _add_up(sums: pa.Table) -> pa.Table:
    """The sums of a block's documents over the cell groups of a wave."""
    doc, known = _flat(sums.column("doc")), _flat(sums.column("known"))
    score, base = (_flat(sums.column(n), np.float64) for n in ("score", "base"))
    return pa.Table.from_batches([_sums_row(sums.column("block")[0].as_py(), doc, score, base, known)])


def _score_group(g: _Globals, shares: np.ndarray, unknown: np.ndarray, heavy_p: np.ndarray, heavy_base: np.ndarray, total: int):
    """Scores of a cell group's tokens, summed per document. ``heavy_p``: the
    root's probability of each heavy word by state, ``heavy_base``: their base."""
    states = len(unknown)
    schema = _SUMS

    def score(lists: pa.Table, state: pa.Table) -> pa.Table:
        tokens, far, answers = _kinds(lists, _TOKENS, _FAR, _SHARES)
        del lists
        if tokens.num_rows + far.num_rows == 0:
            return schema.empty_table()
        k = len(shares[0])
        light = _flat(answers.column("words"))
        order = np.argsort(light, kind="stable")
        light = light[order]
        size = k + len(light)
        customers = np.concatenate((g.customers, _flat(answers.column("times"))[order]))
        to_root = ((g.strength + g.d * _flat(answers.column("tables")).reshape(-1, states)[order])
                   / (g.strength + customers[k:, None])).astype(np.float32)
        to_root = np.concatenate((shares, to_root.T), axis=1)
        del answers
        rows = _cuts(tokens.column("doc"))
        rows = np.concatenate((rows, rows[-1] + _cuts(far.column("doc"))[1:]))
        blocks = np.concatenate((np.asarray(tokens.column("block")), np.asarray(far.column("block"))))
        u, index, context, doc = _tokens_of(tokens)
        keys, far_index, far_word, far_doc = _tokens_of(far)
        del tokens, far
        key = np.concatenate((index.astype(np.int64) * size + _numbered(context, light, k),
                              (len(u) + far_word) * size + (k + np.searchsorted(light, keys))[far_index]))
        # counts of this group's words and (word, context) pairs in training
        count = np.bincount(index[(doc & 1) == 0], minlength=len(u))
        index = np.concatenate((index, (len(u) + far_word).astype(np.int32)))
        doc = np.concatenate((doc, far_doc))
        train = (doc & 1) == 0
        del context, far_index, far_word, far_doc
        pair = np.unique(key)
        back = np.searchsorted(pair, key).astype(np.int32)
        del key
        seen = np.bincount(back[train], minlength=len(pair))
        types = _flat(state.column("words")) if state.num_rows else np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(types, u), max(len(types) - 1, 0))
        has = types[at] == u if len(types) else np.zeros(len(u), dtype=bool)
        stored = _flat(state.column("root_p"), np.float32).reshape(states, -1) if len(types) else None
        pair_word, pair_context = (pair // size).astype(np.int32), (pair % size).astype(np.int32)
        # a pair seen once has one customer at one table; unseen pairs have the parent's share only
        p = np.where(seen == 1, (1 - g.d) / (g.strength + customers[pair_context]), 0.0)
        for s in range(states):
            root = np.concatenate((np.where(has, stored[s][at] if len(types) else 0.0, unknown[s]), heavy_p[s]))
            p += to_root[s][pair_context] * root[pair_word] / states
        if state.num_rows:
            cell_word, cell_context = (_flat(state.column(c)) for c in ("cell_word", "cell_context"))
            if len(cell_word):
                away = cell_word >= len(types)
                code = len(u) + cell_word - len(types)
                cells = types[cell_word[~away]]
                code[~away] = np.minimum(np.searchsorted(u, cells), len(u))
                mine = np.ones(len(code), dtype=bool)
                mine[~away] = np.concatenate((u, [0]))[code[~away]] == cells
                mine[~away] &= code[~away] < len(u)
                of_light = cell_context >= k
                cell_context[of_light] = k + np.searchsorted(light, _flat(state.column("light"))[cell_context[of_light] - k])
                value = _flat(state.column("cell_p"), np.float32).reshape(states, -1).mean(axis=0)
                wanted = code[mine] * size + cell_context[mine]
                where = np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)
                fits = pair[where] == wanted
                p[where[fits]] = value[mine][fits]
        np.log10(p, out=p)
        base = np.concatenate((np.log10((count + 0.1) / (total + 0.1 * (g.types + 1))), heavy_base))
        known = np.concatenate((count > 0, np.ones(k, dtype=bool)))
        parts = []
        for r in np.argsort(blocks, kind="stable"):  # a row per block and kind: its tokens of this group
            x, y = rows[r], rows[r + 1]
            w = index[x:y]
            parts.append(_sums_row(blocks[r], doc[x:y] >> 1, p[back[x:y]], base[w], known[w]))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(parts, schema=schema)

    return score


def _finish_block(pair_score, base, known, total: int):
    """Scores of a block's documents: its heavy words, scored here, and the
    sums that the cell groups found for its other tokens."""
    def finish(docs: pa.Table, sums: pa.Table) -> pa.Table:
        table, word_base, word_known = pair_score.value.reshape(-1), base.value, known.value
        k = len(word_base)
        ids, held, tokens = (docs.column(n).combine_chunks().flatten() for n in ("ids", "held", "tokens"))
        n = len(ids)
        doc = np.repeat(np.arange(n), _flat(docs.column("times")))
        code = _flat(docs.column("context"))
        # (the sums of nothing would be whole numbers)
        out = [np.bincount(doc, weights=w, minlength=n).astype(np.float64) for w in
               (table[code], word_base[code % k], word_known[code % k])]
        if sums.num_rows:
            other = _flat(sums.column("doc"))
            for x, name in zip(out, ("score", "base", "known")):
                x += np.bincount(other, weights=_flat(sums.column(name), np.float64), minlength=n)
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": tokens.cast(pa.int64()),
                         "n_known": pa.array(out[2].round().astype(np.int64)),
                         "train_tokens": pa.array(np.full(n, total)), "base_score": pa.array(out[1]),
                         "score": pa.array(out[0]),
                         "perplexity": pa.array(10.0 ** (-out[0] / np.asarray(tokens)))})

    return finish


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", burn_in: int = 3, states: int = 3,
                    draws: int = 3, share: int = SHARE, group_tokens: int = GROUP_TOKENS, seed: int = 1) -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, perplexity).

    Learns from the rows that are not ``held_out`` (see there); tokens are the
    text's words (A-Z folded; null: none) and one end. ``base_score``: sum of
    log10((c + 0.1) / (N + 0.1 * (V + 1))). ``score``: log10 probability under
    the Pitman-Yor model, averaged over ``states`` Gibbs states after
    ``burn_in`` sweeps; a sweep moves every customer of a cell once (and makes
    ``draws`` moves in a cell at least); perplexity = 10 ** (-score / n_tokens). Repeated rows are documents of their
    own; a row without id is held out. Other columns are not read. Without
    training rows every word is unknown: probabilities are those of the base. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    steps = Steps(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = steps.write("counts", source.mapInArrow(_word_counts, "word long, times long")
                        .groupBy("word").agg(F.sum("times").alias("times")))
    total = found.agg(F.sum("times")).first()[0] or 0
    # a share of 1/share each: at most `share` words
    rows = found.where(F.col("times") * share >= total).collect()
    steps.drop("counts")
    heavy = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    times = np.array([r["times"] for r in rows], dtype=np.int64)[np.argsort(heavy)]
    heavy = np.sort(heavy)
    k = len(heavy) + 2
    groups = max(1, math.ceil(total / group_tokens))
    homes = max(1, groups // 4)  # groups of light contexts
    waves = min(WAVES, groups)
    lists = steps.write("lists", source.mapInArrow(_distribute(heavy, groups, waves), _LISTS_SQL), "wave")

    columns = ["part", "kind", "words", "times", "doc", "context"]
    firsts = []
    for w in range(waves):
        counted = lists.where(f"wave = {w}").select(columns).unionByName(
            lists.where(f"wave = {_WAVE_OF_COUNTS} and part % {waves} = {w}").select(columns))
        firsts.append(steps.write(f"first{w}", counted.groupBy("part").applyInArrow(
            _first_state(k, heavy, times), _sql(_FIRST_COLUMNS))))
    state = reduce(DataFrame.unionByName, firsts)
    ones, twos, root_ones, root_twos, types = state.agg(
        F.sum("ones"), F.sum("twos"), F.sum("root_ones"), F.sum("root_twos"), F.sum("types")).first()
    discount, root_discount = _discount(ones, twos), _discount(root_ones, root_twos)
    asked = steps.write("asked", state.select("part", "every", "every_counts").mapInArrow(_send(homes), _SENT))
    contexts = steps.write("contexts", asked.groupBy("home").applyInArrow(_count_contexts, _SENT))
    state = state.drop("types", "every", "every_counts")
    shares, unknown, heavy_p = [], [], []
    for i in range(burn_in + states):
        tables, customers = np.zeros(3 * k), np.zeros(3 * k)
        sums = state.select(F.explode(F.arrays_zip("context", "tables", "customers")).alias("s")).select("s.*")
        for r in sums.groupBy("context").agg(F.sum("tables").alias("t"), F.sum("customers").alias("c")).collect():
            tables[r["context"]], customers[r["context"]] = r["t"], r["c"]
        if i == 0:  # customers from far cells, at the one table of their word in the root
            far = tables[2 * k:]
            new = (far > 0) & (customers[k:2 * k] == 0)
            tables[k:2 * k] += new
            customers[k:2 * k] += far
            tables[_NONE], customers[_NONE] = tables[_NONE] + new.sum(), customers[_NONE] + far.sum()
        g = _Globals(k, tables, customers, types or 0, discount, root_discount)
        keep = i >= burn_in
        if keep:
            shares.append(g.share())
            unknown.append(g.unknown_p())
            heavy_p.append(g.heavy_p())
        sent = state.select("part", "light", "light_tables").mapInArrow(_send(homes), _SENT)
        answers = contexts.groupBy("home").cogroup(sent.groupBy("home")).applyInArrow(
            _sum_tables, "home int, part int, numbers binary")
        state = steps.write(f"state{i + 1}", state.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
            _sweep(g, heavy, i == 0, keep, i < burn_in + states - 1, draws, seed + i), _sql(_STATE_COLUMNS)))
        steps.drop(*([f"state{i}"] if i else [f"first{w}" for w in range(waves)]))
    steps.drop("contexts")
    shares, unknown = np.array(shares), np.array(unknown)

    base = np.log10((np.concatenate(([0, 0], times)) + 0.1) / (total + 0.1 * (g.types + 1)))
    sent = state.select("part", "light", "kept").mapInArrow(_send(homes), _SENT)
    weights = asked.groupBy("home").cogroup(sent.groupBy("home")).applyInArrow(
        _light_tables(states), "part int, kind byte, words binary, times binary, tables binary")
    weights = steps.write("weights", weights.withColumn("wave", F.expr(f"part % {waves}")), "wave")
    steps.drop("asked")
    cells = state.select("part", "words", "cell_word", "cell_context", "light", "cell_p", "root_p")
    sums = []
    for w in range(waves):
        tokens = lists.where(f"wave = {w}").select(*columns, "block").unionByName(
            weights.where(f"wave = {w}").drop("wave"), allowMissingColumns=True)
        scored = tokens.groupBy("part").cogroup(cells.where(f"part % {waves} = {w}").groupBy("part")).applyInArrow(
            _score_group(g, shares, unknown, np.array(heavy_p), base, total), _SUMS_SQL)
        sums.append(steps.write(f"sums{w}", scored.groupBy("block").applyInArrow(_add_up, _SUMS_SQL)))
        steps.drop_part("lists", f"wave={w}")
    steps.drop("weights")
    scored = reduce(DataFrame.unionByName, sums)
    tables = [spark.sparkContext.broadcast(x) for x in _heavy_tables(lists, state, heavy, g, shares, unknown, base)]
    blocks = lists.where(f"wave = {_WAVE_OF_DOCS}").select("block", "ids", "held", "tokens", "times", "context")
    return (blocks.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(
        _finish_block(*tables, int(total)), "doc_id long, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double, perplexity double"))


def _discount(ones: int | None, twos: int | None) -> float:
    """Discount from the numbers of cells of one and of two customers."""
    ones, twos = ones or 0, twos or 0
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def _heavy_states(heavy: np.ndarray, states: int):
    """(word, context, p) of heavy words: cells, and the root's per state (context -1 - state)."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words, cell_word, cell_context, cell_p, root_p = (
                    _unpack(batch.column(n)[r], np.float32 if n.endswith("_p") else np.int64)
                    for n in ("words", "cell_word", "cell_context", "cell_p", "root_p"))
                mine = np.isin(words, heavy.view(np.int64))
                cells = np.flatnonzero(cell_word < len(words))
                cells = cells[mine[cell_word[cells]]]
                p = cell_p.reshape(states, -1).mean(axis=0)[cells] if len(cells) else np.zeros(0)
                at = np.flatnonzero(mine)
                root = root_p.reshape(states, -1)[:, at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((words[cell_word[cells]], np.tile(words[at], states)))),
                     pa.array(np.concatenate((cell_context[cells], -1 - np.repeat(np.arange(states), len(at)))).astype(np.int32)),
                     pa.array(np.concatenate((p, root.reshape(-1))).astype(np.float64))],
                    names=["word", "context", "p"])

    return pick


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, context, customers) of the lists of heavy pairs."""
    for batch in batches:
        types, index, context, n = _tokens_of(pa.Table.from_batches([batch]), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(types[index]), pa.array(context.astype(np.int32)), pa.array(n)],
                                         names=["word", "context", "n"])


def _heavy_tables(lists, state, heavy, g, shares, unknown, base):
    """(log10 p of each pair of context and heavy word, base log10 of each heavy
    word, whether it is known), with the numbers of the contexts."""
    k, states = len(heavy) + 2, len(unknown)
    counts = np.zeros((k, k))
    pairs = (lists.where(f"wave = {_WAVE_OF_COUNTS}").select("words", "times", "doc", "context")
             .mapInArrow(_pairs, "word long, context int, n long").groupBy("word", "context").agg(F.sum("n").alias("n")))
    found = pairs.toArrow()
    if found.num_rows:
        w = np.searchsorted(heavy, np.asarray(found.column("word")).view(np.uint64)) + 2
        counts[np.asarray(found.column("context")), w] = np.asarray(found.column("n"))
    root = np.tile(unknown[:, None], (1, k))
    cells = state.mapInArrow(_heavy_states(heavy, states), "word long, context int, p double").toArrow()
    context = np.asarray(cells.column("context"))
    w = np.searchsorted(heavy, np.asarray(cells.column("word")).view(np.uint64)) + 2
    p = np.asarray(cells.column("p"))
    of_root = context < 0
    root[-1 - context[of_root], w[of_root]] = p[of_root]
    single = (counts == 1) / (g.strength + g.customers)[:, None] * (1 - g.d)
    single[_NONE] = 0
    table = single + np.mean([shares[s][:, None] * root[s][None, :] for s in range(states)], axis=0)
    table[context[~of_root], w[~of_root]] = p[~of_root]
    return np.log10(table), base, (np.arange(k) > _START).astype(np.float64)
