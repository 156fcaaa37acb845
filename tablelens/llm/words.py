"""Words and word windows of whole texts as 64-bit hashes, in numpy.

A word is a run of bytes other than space and 0x09-0x0D. In UTF-8 these
separators never occur inside a longer character, so everything here works on
the UTF-8 bytes of an Arrow column. Texts are cut into blocks of a bounded
number of bytes (between words), so memory does not follow the longest text.

A word's hash is ``sum((byte + 1) * B**i)`` over its bytes modulo 2**64, mixed;
it comes from one prefix sum over a block and does not depend on where the
word stands. Two different words share a hash with a probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``B**i`` and its inverse modulo 2**64 for i < n."""
    size = 1 << max(20, int(n).bit_length())
    if size not in _powers:
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for b in (_BASE, inverse):
            x = np.ones(size, dtype=np.uint64)
            x[1:] = np.uint64(b)
            tables.append(np.multiply.accumulate(x))
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def find_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a run of bytes."""
    if len(data) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = ~_SEPARATOR[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts = edge[inside[edge]]
    ends = edge[~inside[edge]]
    if inside[0]:
        starts = np.concatenate(([0], starts))
    if inside[-1]:
        ends = np.concatenate((ends, [len(data)]))
    return starts, ends


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    folded = (_LOWER[data] if lower else data).astype(np.uint64)
    folded += np.uint64(1)
    folded *= power[: len(data)]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(folded, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def _blocks(data: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Cut a text of ``begin..end`` between words into blocks of about BLOCK bytes."""
    while end - begin > 2 * BLOCK:
        cut = begin + BLOCK
        while cut < end:
            gap = np.flatnonzero(_SEPARATOR[data[cut:min(cut + 4096, end)]])
            if len(gap):
                cut += int(gap[0])
                break
            cut = min(cut + 4096, end)
        yield begin, cut
        begin = cut
    yield begin, end


def text_groups(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts together hold about ``size`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words_of_rows(data: np.ndarray, offsets: np.ndarray, i: int, j: int,
                  lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows i..j of a column: (hash, start, end, first word of each row
    plus the total). Starts and ends are places in ``data``."""
    begin, end = int(offsets[i]), int(offsets[j])
    parts = []
    pieces = _blocks(data, begin, end) if j == i + 1 else [(begin, end)]
    for a, b in pieces:
        part = data[a:b]
        s, e = find_words(part)
        if j > i + 1:  # a word ends where its row ends
            s, e = _split_at_rows(part, s, e, offsets[i:j + 1] - a)
        parts.append((hash_words(part, s, e, lower), s + a, e + a))
    h, s, e = (np.concatenate([p[k] for p in parts]) if len(parts) > 1 else parts[0][k] for k in range(3))
    first = np.searchsorted(s, offsets[i:j + 1], side="left")
    first[-1] = len(s)
    return h, s, e, first


def _split_at_rows(part, s, e, rows):
    """Words that run over the end of a row are cut there."""
    if len(s) == 0:
        return s, e
    inner = rows[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(part))])
    w = np.searchsorted(s, inner, side="right") - 1
    crosses = (w >= 0) & (s[np.maximum(w, 0)] < inner) & (e[np.maximum(w, 0)] > inner)
    cut = inner[crosses]
    if len(cut) == 0:
        return s, e
    s = np.sort(np.concatenate((s, cut)))
    e = np.sort(np.concatenate((e, cut)))
    return s, e


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (of one text); none if it has fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[i:i + n]
    return mix(out)


def split_words(text: bytes) -> list[bytes]:
    """Words of a byte string (bytes.split without arguments cuts at these separators)."""
    return text.split()
