"""Column profiles.

All measures of a table are batched into one aggregate (the application ran
one pass per measure per column). Distinct counts are exact by default; pass
``approx=True`` for ``approx_count_distinct`` on very wide or very large tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import rows_frame

from ..functions.types import column_classes, data_columns
from .order import GlobalOrder, default_order


def n_unique_expr(c: str, approx: bool = False) -> Column:
    """A4: distinct values, where null counts as one more value.

    Mixing a distinct count with ordinary aggregates sends every aggregate
    through Spark's row expansion; profile functions therefore compute
    distinct counts in an aggregate of their own (``distinct_counts``)."""
    distinct = F.approx_count_distinct(F.col(c)) if approx else F.count_distinct(F.col(c))
    return (distinct + F.max(F.col(c).isNull().cast("int"))).cast("bigint")


DISTINCT_BATCH = 8


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> dict[str, int]:
    """Non-null distinct values per column, in one aggregate that holds only
    distinct counts (exact: one expansion per column; ``approx``: HyperLogLog++
    sketches, no expansion)."""
    cols = list(cols)
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        return {c: int(row[f"d{i}"]) for i, c in enumerate(cols)}
    # exact: at most DISTINCT_BATCH columns per aggregate, so a wide table never
    # expands every row hundreds of times in one stage
    out: dict[str, int] = {}
    for start in range(0, len(cols), DISTINCT_BATCH):
        part = cols[start:start + DISTINCT_BATCH]
        row = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(part)]).first()
        out.update({c: int(row[f"d{i}"]) for i, c in enumerate(part)})
    return out


#: A whole-number column is counted by bitmaps where its span is at most so many times its values.
DENSE = 8


def dense_distinct_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """A4 for whole-number columns by bitmaps: every value is a bit of the bitmap of
    its range of 32,768 numbers, bitmaps of a range are merged by OR (partial
    before the shuffle), and the set bits are counted. Exact; rows are not expanded
    per distinct value and no value is shuffled. Good where values lie densely: a
    range costs 4 KB however few of its numbers occur."""
    cols = list(cols)
    if not cols:
        return {}
    pairs = ", ".join(f"{i}, CAST(`{c.replace('`', '``')}` AS BIGINT)" for i, c in enumerate(cols))
    values = df.select(F.expr(f"stack({len(cols)}, {pairs}) AS (c, v)")).where("v is not null")
    maps = values.groupBy("c", F.bitmap_bucket_number("v").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
    got = {r["c"]: int(r["k"]) for r in maps.groupBy("c").agg(F.sum(F.bitmap_count("bits")).alias("k")).collect()}
    return {c: got.get(i, 0) for i, c in enumerate(cols)}


def dense_columns(df: DataFrame, cols: Sequence[str], facts: dict[str, tuple]) -> list[str]:
    """The whole-number columns of ``cols`` that lie densely, by (values, min, max)."""
    def dense(c):
        n, lo, hi = facts.get(c, (0, None, None))
        return n and lo is not None and isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) \
            and abs(lo) < 2 ** 53 and abs(hi) < 2 ** 53 and hi - lo < DENSE * n + 32768

    return [c for c in cols if dense(c)]


def n_unique(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """A4 for many columns: one row per column (position, column, unique_count)."""
    cols = list(cols) if cols is not None else data_columns(df)
    nulls = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(f"z{i}") for i, c in enumerate(cols)]).first()
    dist = distinct_counts(df, cols, approx)
    rows = [(i, c, dist[c] + int(nulls[f"z{i}"] or 0)) for i, c in enumerate(cols)]
    return rows_frame(df.sparkSession, rows, "position long, column string, unique_count long")


@dataclass
class TableFacts:
    """Every per-column measure of a table from two aggregates (one scan for
    the ordinary measures, one for the distinct counts) — pass 4 of an
    analysis. KPIs, statistics, anomalies, insights, the numeric summary and
    the histogram bounds all read from it instead of scanning again."""

    rows: int
    columns: list[str]
    nulls: dict[str, int]
    count: dict[str, int]
    sum: dict[str, float | None]
    mean: dict[str, float | None]
    min: dict[str, float | None]
    max: dict[str, float | None]
    std: dict[str, float | None]
    distinct: dict[str, int]

    def unique(self, c: str) -> int:
        """A4: distinct values with null counted as one more."""
        return self.distinct[c] + (1 if self.nulls[c] > 0 else 0)


def table_facts(df: DataFrame, approx: bool = False, distinct: Sequence[str] | None = None) -> TableFacts:
    """``distinct``: the columns whose distinct values are counted (all by default)."""
    cc = column_classes(df)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cc.columns):
        aggs.append(F.count(F.col(c)).alias(f"n{i}"))
        if c in cc.numeric_wide:
            x = F.col(c).cast("double")
            aggs += [F.sum(x).alias(f"t{i}"), F.avg(x).alias(f"m{i}"), F.min(x).alias(f"lo{i}"),
                     F.max(x).alias(f"hi{i}"), F.stddev_samp(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    counted = cc.columns if distinct is None else list(distinct)
    known = {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cc.columns) if c in cc.numeric_wide}
    dense = [] if approx else dense_columns(df, counted, known)
    dist = {**dense_distinct_counts(df, dense), **distinct_counts(df, [c for c in counted if c not in dense], approx)}
    rows = int(row["_rows"])
    wide = {c: i for i, c in enumerate(cc.columns) if c in cc.numeric_wide}

    def pick(prefix):
        return {c: row[f"{prefix}{i}"] for c, i in wide.items()}

    count = {c: int(row[f"n{i}"]) for i, c in enumerate(cc.columns)}
    return TableFacts(rows, cc.columns, {c: rows - count[c] for c in cc.columns}, count, pick("t"), pick("m"),
                      pick("lo"), pick("hi"), pick("s"), dist)


def column_statistics(df: DataFrame, approx: bool = False, facts: TableFacts | None = None) -> DataFrame:
    """A3: one row per column: position, column, dtype, null_count,
    unique_count and, for numeric columns (small integers included) holding
    data, mean / min / max / sample std (null where undefined)."""
    cc = column_classes(df)
    f = facts if facts is not None and all(c in facts.distinct for c in cc.columns) else table_facts(df, approx)
    rows = []
    for i, c in enumerate(cc.columns):
        wide = c in cc.numeric_wide
        rows.append((i, c, cc.dtypes[c].simpleString(), f.nulls[c], f.unique(c),
                     f.mean[c] if wide else None, f.min[c] if wide else None,
                     f.max[c] if wide else None, f.std[c] if wide else None))
    return rows_frame(df.sparkSession, 
        rows, "position long, column string, dtype string, null_count long, unique_count long, "
              "mean double, min double, max double, std double")


def null_percent(df: DataFrame) -> DataFrame:
    """Nulls / (rows × columns) × 100; 0 for an empty table."""
    cols = data_columns(df)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0))
    agg = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"))
    pct = (F.when(F.col("rows") > 0, F.col("nulls") / (F.col("rows") * F.lit(len(cols))) * 100)
           .otherwise(F.lit(0.0)) if cols else F.lit(0.0))
    return agg.select(
        F.col("rows").cast("bigint").alias("rows"),
        F.lit(len(cols)).cast("bigint").alias("columns"),
        F.col("nulls").cast("bigint").alias("null_cells"),
        pct.cast("double").alias("null_percent"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) of the non-null values of ``col`` (one hash aggregate)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def top_value(df: DataFrame, col: str) -> DataFrame:
    """A5: the most frequent non-null value; ties go to the smallest value.
    (value, count), one row, or none for an all-null column."""
    vc = value_counts(df, col)
    return (vc.orderBy(F.col("count").desc(), F.col(col).asc()).limit(1)
            .select(F.col(col).cast("string").alias("value"), F.col("count").cast("bigint").alias("count")))


# ---------------------------------------------------------------------------
# M6 describe(include='all'), missing cells → 0
# ---------------------------------------------------------------------------

def _lerp(a: float, b: float, t: float) -> float:
    # the library's linear interpolation, including its form for t >= 0.5
    d = b - a
    return b - d * (1 - t) if t >= 0.5 else a + d * t


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], order: Sequence[str] | str | None = None,
                    n_rows: int | None = None) -> list[float | None]:
    """Exact linear-interpolation quantiles of ``col`` without collecting the
    column: the sorted positions are found with range buckets (order.py) and
    only the buckets that hold them are sorted. Ties are broken by ``order``."""
    order = default_order(df, order)
    vals = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))) \
        .select(F.col(col).cast("double").alias("_v"), *order)
    key = ["_v"] + [c for c in order if c != "_v"]
    n = vals.count() if n_rows is None else n_rows
    if n == 0:
        return [None for _ in qs]
    go = GlobalOrder.build(vals, key, n_rows=n)
    want = {}
    for q in qs:
        pos = (n - 1) * q
        lo = int(pos // 1)
        want[q] = (lo, min(lo + 1, n - 1), pos - lo)
    positions = sorted({p for lo, hi, _ in want.values() for p in (lo, hi)})
    got = {r["_idx"]: r["_v"] for r in go.select_positions(positions).select("_idx", "_v").collect()}
    return [_lerp(got[lo], got[hi], t) for lo, hi, t in (want[q] for q in qs)]


def exact_quantiles_many(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                         order: Sequence[str] | str | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of many columns with one bucketed order: the columns are
    unpivoted to (column, value) and ordered by (column, value, table order),
    so column ``c`` holds the contiguous positions [start_c, start_c + n_c).
    A few jobs in total instead of a few per column."""
    order = default_order(df, order)
    cols = list(cols)
    if not cols:
        return {}
    parts = ", ".join(f"{i}, CAST(`{c.replace('`', '``')}` AS DOUBLE)" for i, c in enumerate(cols))
    keep = [F.col(o) for o in order]
    long = (df.select(F.expr(f"stack({len(cols)}, {parts}) AS (_c, _v)"), *keep)
            .filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    sizes = {r["_c"]: int(r["count"]) for r in long.groupBy("_c").count().collect()}   # one row per column
    n = [sizes.get(i, 0) for i in range(len(cols))]
    starts = [sum(n[:i]) for i in range(len(cols))]
    want: dict[int, list[tuple[int, int, float]]] = {}
    for i in range(len(cols)):
        if n[i] == 0:
            continue
        for q in qs:
            pos = (n[i] - 1) * q
            lo = int(pos // 1)
            want.setdefault(i, []).append((starts[i] + lo, starts[i] + min(lo + 1, n[i] - 1), pos - lo))
    out = {c: [None for _ in qs] for c in cols}
    if not want:
        return out
    go = GlobalOrder.build(long, ["_c", "_v", *order], n_rows=sum(n))
    positions = sorted({p for ws in want.values() for lo, hi, _ in ws for p in (lo, hi)})
    got = {r["_idx"]: r["_v"] for r in go.select_positions(positions).select("_idx", "_v").collect()}
    for i, ws in want.items():
        out[cols[i]] = [_lerp(got[lo], got[hi], t) for lo, hi, t in ws]
    return out


def describe_all(df: DataFrame, order: Sequence[str] | str | None = None, exact: bool = True) -> DataFrame:
    """M6: count, unique, top, freq, mean, std, min, 25%, 50%, 75%, max per
    column; cells that do not apply are 0 (``top`` → ``"0"``). Numeric columns
    get the numeric measures; text and Boolean columns get unique / top / freq
    (ties → smallest value); date columns get the count only.

    Quartiles are exact by default (sorting only the needed range buckets);
    ``exact=False`` uses ``percentile_approx`` in the same aggregate."""
    spark = df.sparkSession
    cc = column_classes(df)
    cat = [c for c in cc.columns if c in cc.text or cc.dtypes[c].simpleString() == "boolean"]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cc.columns):
        aggs.append(F.count(F.col(c)).alias(f"n{i}"))
        if c in cc.numeric_wide:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
            if not exact:
                aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{i}"))
    row = df.agg(*aggs).first()
    dist = distinct_counts(df, cat)
    tops = {}
    for c in cat:
        t = top_value(df, c).first()
        tops[c] = (t["value"], t["count"]) if t else (None, None)
    numeric_with_data = [c for i, c in enumerate(cc.columns) if c in cc.numeric_wide and row[f"n{i}"]]
    quarts = exact_quantiles_many(df, numeric_with_data, [0.25, 0.5, 0.75], order) if exact else {}
    out = []
    for i, c in enumerate(cc.columns):
        n = int(row[f"n{i}"])
        rec = {"position": i, "column": c, "count": float(n), "unique": 0.0, "top": "0", "freq": 0.0,
               "mean": 0.0, "std": 0.0, "min": 0.0, "p25": 0.0, "p50": 0.0, "p75": 0.0, "max": 0.0}
        if c in cc.numeric_wide and n > 0:
            if exact:
                qv = quarts[c]
            else:
                qv = row[f"q{i}"]
            rec.update(mean=row[f"m{i}"], std=row[f"s{i}"] if row[f"s{i}"] is not None else 0.0,
                       min=row[f"lo{i}"], max=row[f"hi{i}"], p25=qv[0], p50=qv[1], p75=qv[2])
        if c in cat and n > 0:
            top, freq = tops[c]
            rec.update(unique=float(dist[c]), top=str(top), freq=float(freq))
        out.append(rec)
    schema = ("position long, column string, count double, unique double, top string, freq double, "
              "mean double, std double, min double, p25 double, p50 double, p75 double, max double")
    return rows_frame(spark, [tuple(r[k] for k in ["position", "column", "count", "unique", "top", "freq",
                                                       "mean", "std", "min", "p25", "p50", "p75", "max"])
                                  for r in out], schema)
