"""Exact quantiles of many columns by narrowing (M6, A3): no range shuffle.

A position of a sorted column is bracketed by two of its values, marks of a
quantile sketch. One scan counts, for all open brackets, how many values lie before
it, on its ends and inside it (generated code); one sketches the values inside those
still too large, whose marks give the next brackets. So two scans leave less than a
hundredth of a bracket, whatever the column's size; a value that fills a whole
bracket (a third of all rows, say) is an end of it and is answered by the counts. The
sketch only chooses where to look; the counts decide. Brackets of at most ``keep`` values are read as (value, count),
aggregated map-side, and the positions picked from them.

What moves is one row of counts and sketches per task and scan; what reaches the
driver is that row, and at most ``keep`` values per bracket at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import _lerp

_MARKS = 1024
_ACCURACY = 10_000
KEEP = 4096


@dataclass(frozen=True)
class _Bracket:
    """The values strictly between two values of a column (none, where they are equal)."""
    column: int
    lo: float
    hi: float


def _number(c: str) -> Column:
    x = F.col(f"`{c.replace('`', '``')}`").cast("double")
    return F.when(~F.isnan(x), x)


def _marks(x: Column) -> Column:
    return F.percentile_approx(x, [k / _MARKS for k in range(_MARKS + 1)], _ACCURACY)


def _next(b: _Bracket, marks: Sequence[float], inside: int, rank: int) -> _Bracket:
    """The part of a bracket that should hold its value of that rank (from 0)."""
    slack = 2 * _MARKS / _ACCURACY + 1
    left, right = (math.floor(_MARKS * rank / inside - slack), math.ceil(_MARKS * (rank + 1) / inside + slack))
    lo = marks[left] if left >= 0 else b.lo
    hi = marks[right] if right <= _MARKS else b.hi
    if lo == hi:  # one value fills the marks around: it becomes an end
        return _Bracket(b.column, b.lo, hi)
    return _Bracket(b.column, lo, hi)


def positions_by_narrowing(df: DataFrame, cols: Sequence[str], positions: dict[str, Sequence[int]] | None = None,
                           keep: int = KEEP, *, of_sizes=None) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """(number of values per column, value per (column, position)): the values at
    sorted positions (from 0) of numeric columns, as doubles. Nulls and NaN are
    no values; positions outside a column are left out. ``of_sizes`` may give the
    positions of a column from its number of values instead."""
    cols = list(cols)
    if not cols:
        return {}, {}
    x = {c: _number(c) for c in cols}
    row = df.agg(*[f(x[c]).alias(f"{n}{i}") for i, c in enumerate(cols)
                   for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("m", _marks))]).first()
    sizes = {c: int(row[f"n{i}"]) for i, c in enumerate(cols)}
    found: dict[tuple[str, int], float] = {}
    todo: dict[tuple[str, int], _Bracket] = {}   # open positions and the bracket to look into next
    outer: dict[tuple[str, int], _Bracket] = {}  # what is sure of them (ends included)
    for i, c in enumerate(cols):
        for p in set(of_sizes(sizes[c]) if of_sizes else positions.get(c, ())):
            if not 0 <= p < sizes[c]:
                continue
            all_of_it = _Bracket(i, row[f"lo{i}"], row[f"hi{i}"])
            if all_of_it.lo == all_of_it.hi:
                found[c, p] = all_of_it.lo
            else:
                outer[c, p] = all_of_it
                todo[c, p] = _next(all_of_it, row[f"m{i}"], sizes[c], p)
    small: dict[tuple[str, int], tuple[_Bracket, int]] = {}
    while todo:
        open_ = sorted(set(todo.values()), key=lambda b: (b.column, b.lo, b.hi))
        aggs = []
        for k, b in enumerate(open_):
            v, lo, hi = x[cols[b.column]], F.lit(b.lo), F.lit(b.hi)
            within = (v > lo) & (v < hi)
            aggs += [F.count_if(v < lo).alias(f"below{k}"), F.count_if(v == lo).alias(f"lo{k}"),
                     F.count_if(within).alias(f"in{k}"), F.count_if(v == hi).alias(f"hi{k}")]
        row, number = df.agg(*aggs).first(), {b: k for k, b in enumerate(open_)}
        large: dict[tuple[str, int], tuple[_Bracket, int, int]] = {}
        for (c, p), b in list(todo.items()):
            k, wide = number[b], outer[c, p]
            to_lo = row[f"below{k}"] + row[f"lo{k}"]
            to_hi = to_lo + row[f"in{k}"]
            del todo[c, p]
            if p < row[f"below{k}"]:      # the sketch was off: the value is left of the bracket
                outer[c, p] = todo[c, p] = _Bracket(b.column, wide.lo, b.lo)
            elif p < to_lo:
                found[c, p] = b.lo
            elif p < to_hi:
                outer[c, p] = b
                if row[f"in{k}"] <= keep:
                    small[c, p] = b, p - to_lo
                else:
                    large[c, p] = b, row[f"in{k}"], p - to_lo
            elif p < to_hi + (row[f"hi{k}"] if b.hi > b.lo else 0):
                found[c, p] = b.hi
            else:
                outer[c, p] = todo[c, p] = _Bracket(b.column, b.hi, wide.hi)
        if large:
            wide_ones = sorted({b for b, _, _ in large.values()}, key=lambda b: (b.column, b.lo, b.hi))
            inside = [(x[cols[b.column]] > b.lo) & (x[cols[b.column]] < b.hi) for b in wide_ones]
            marks = df.where(reduce(or_, [F.coalesce(i, F.lit(False)) for i in inside])).agg(
                *[_marks(F.when(i, x[cols[b.column]])) for i, b in zip(inside, wide_ones)]).first()
            for key, (b, n, rank) in large.items():
                todo[key] = _next(b, marks[wide_ones.index(b)], n, rank)
    if small:
        last = sorted({b for b, _ in small.values()}, key=lambda b: (b.column, b.lo, b.hi))
        cells = F.array(*[F.struct(F.lit(k).alias("b"),
                                   F.when((x[cols[b.column]] > b.lo) & (x[cols[b.column]] < b.hi), x[cols[b.column]]).alias("v"))
                          for k, b in enumerate(last)])
        values: dict[int, list[tuple[float, int]]] = {}
        for r in (df.select(F.inline(F.filter(cells, lambda s: s["v"].isNotNull()))).groupBy("b", "v")
                  .agg(F.count(F.lit(1)).alias("n")).collect()):   # at most `keep` rows per bracket
            values.setdefault(r["b"], []).append((r["v"], r["n"]))
        for (c, p), (b, rank) in small.items():
            for v, n in sorted(values[last.index(b)]):
                if rank < n:
                    found[c, p] = v
                    break
                rank -= n
    return sizes, found


def quantiles_by_narrowing(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                           keep: int = KEEP) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of numeric columns, equal to
    ``exact_quantiles_many``; None for a column without values."""
    def ends(n: int) -> list[int]:
        return [p for q in qs for p in (int((n - 1) * q // 1), min(int((n - 1) * q // 1) + 1, n - 1))] if n else []

    sizes, found = positions_by_narrowing(df, cols, keep=keep, of_sizes=ends)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = sizes[c]
        out[c] = []
        for q in qs:
            if n == 0:
                out[c].append(None)
                continue
            pos = (n - 1) * q
            lo = int(pos // 1)
            out[c].append(_lerp(found[c, lo], found[c, min(lo + 1, n - 1)], pos - lo))
    return out
