"""Global row order without a one-partition window.

Order-dependent operators (forward fill, first-half / second-half trend,
every-n-th-row samples, deep pages, exact quantiles) need positions in the
total order of a whole table. ``Window.orderBy`` without ``partitionBy`` moves
every row into one task. Instead:

1. Sample the order key (a bounded sample, ~``OVERSAMPLE`` rows per bucket) and
   take ``B - 1`` boundary keys from it. Boundaries become *literals*, so the
   bucket of a row is a pure function of the row and every later job agrees
   on it (``repartitionByRange`` would re-sample and could disagree).
2. ``bucket = `` a binary search over the literal boundaries (``log2 B``
   comparisons per row): a ``CASE`` tree up to 255 boundaries, an unrolled
   search over one array literal beyond.
3. One aggregate per bucket (count, last non-null value, ...) gives ``B``
   rows; prefix sums over those ``B`` rows happen on the driver.
4. Inside a bucket, a window ``PARTITION BY bucket ORDER BY key`` gives local
   positions; global position = bucket offset + local position.

The order key must be unique (a total order). Tables carry it as one or more
columns; marked ones, and those in ``types.HIDDEN_COLUMNS``, are hidden from analysis.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import array_literal
from ..functions.types import order_columns

ROWS_PER_BUCKET = 4_000_000
MAX_BUCKETS = 16384
MAX_TREE_BOUNDS = 255
OVERSAMPLE = 32
BUCKET = "_bucket"
SEED = 20240101


def default_order(df: DataFrame, order: Sequence[str] | str | None) -> list[str]:
    if order is None:
        marked = order_columns(df)                               # file order from load_table
        if marked:
            return marked
        if "_row_id" in df.columns:
            return ["_row_id"]
        if "_file" in df.columns and "_pos" in df.columns:
            return ["_file", "_block", "_pos"] if "_block" in df.columns else ["_file", "_pos"]
        raise ValueError("an order is needed: pass order=[...] or add a _row_id column")
    return [order] if isinstance(order, str) else list(order)


def typed_lit(value, dtype: T.DataType) -> Column:
    """A literal of exactly ``dtype`` for a value collected from that type."""
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(dtype)
    if isinstance(dtype, (T.TimestampType, T.DateType, T.StringType, T.BooleanType, T.DoubleType)):
        return F.lit(value)
    return F.lit(value).cast(dtype)


FIXED_WIDTH = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
               T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def ordering_key(df: DataFrame, order: Sequence[str]) -> Column:
    """The order key as an aggregate ordering: the bare column when it is one
    fixed-width column (``max_by`` then runs as a hash aggregate), else a struct
    (Spark plans a sort-based partial aggregate)."""
    if len(order) == 1 and isinstance(df.schema[order[0]].dataType, FIXED_WIDTH):
        return F.col(order[0])
    return key_struct(order)


def key_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def _struct_lit(row, fields: list[T.StructField]) -> Column:
    return F.struct(*[typed_lit(row[i], f.dataType).alias(f.name) for i, f in enumerate(fields)])


def _bucket_tree(keys: list[Column], bounds: list[tuple[int, Column]], lo: int, hi: int) -> Column:
    """Buckets ``lo..hi``; bucket ``b`` holds keys in ``[bounds[b-1], bounds[b])``.
    A bound is (m, literal): the key's first ``m`` columns compared with it."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi + 1) // 2
    m, bound = bounds[mid - 1]
    return F.when(keys[m - 1] < bound, _bucket_tree(keys, bounds, lo, mid - 1)) \
        .otherwise(_bucket_tree(keys, bounds, mid, hi))


def _shortest_prefixes(rows: list[tuple]) -> list[int]:
    """For each sorted, distinct boundary the shortest prefix length that is
    still greater than the previous boundary's prefix of that length.

    Cutting a boundary to ``(prefix, -inf, ...)`` keeps the boundaries
    strictly increasing, so the range partition stays valid, and most
    comparisons touch only the leading column (small generated code even for
    wide composite keys; a dominant leading value still gets longer prefixes
    and is split across buckets)."""
    out = []
    for i, r in enumerate(rows):
        if i == 0:
            out.append(1)
            continue
        prev = rows[i - 1]
        m = 1
        while m < len(r) and tuple(r[:m]) == tuple(prev[:m]):
            m += 1
        out.append(m)
    return out


def choose_buckets(df: DataFrame, n_rows: int) -> int:
    try:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    except ValueError:          # e.g. "auto" on some platforms
        parts = df.sparkSession.sparkContext.defaultParallelism
    want = max(parts, math.ceil(n_rows / ROWS_PER_BUCKET))
    return int(max(1, min(MAX_BUCKETS, want, max(1, n_rows))))


@dataclass
class GlobalOrder:
    """Deterministic range buckets over the total order ``order`` of ``df``."""

    df: DataFrame
    order: list[str]
    n_rows: int
    bucket: Column | None
    n_buckets: int
    search: tuple | None = None      # (padded boundary array literal, steps) for large B

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[str] | str | None = None,
              n_rows: int | None = None, buckets: int | None = None) -> "GlobalOrder":
        order = default_order(df, order)
        n = df.count() if n_rows is None else n_rows
        b = buckets or choose_buckets(df, n)
        key = key_struct(order)
        fields = [df.schema[c] for c in order]
        if b <= 1 or n <= 1:
            return cls(df, order, n, F.lit(0), 1)
        fraction = min(1.0, b * OVERSAMPLE / max(n, 1))
        sample = df.select(*order)
        if fraction < 1.0:
            sample = sample.sample(withReplacement=False, fraction=fraction, seed=SEED)
        # the sample is bounded (about B * OVERSAMPLE rows): ranking it in one task is cheap
        ranked = (sample.select(key.alias("k"))
                  .withColumn("r", F.row_number().over(Window.orderBy("k")).cast("long"))
                  .withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))))
        step_rows = (ranked
                     .withColumn("slot", F.floor((F.col("r") - 1) * F.lit(b).cast("long") / F.col("m")))
                     .withColumn("first", F.col("r") == F.min("r").over(Window.partitionBy("slot")))
                     .filter(F.col("first") & (F.col("slot") > 0))
                     .orderBy("slot")
                     .select("k"))
        rows, seen = [], set()
        for r in step_rows.collect():
            t = tuple(r["k"])
            if t not in seen:           # repeated boundaries only when the key is not unique
                seen.add(t)
                rows.append(t)
        if not rows:
            return cls(df, order, n, F.lit(0), 1)
        prefixes = _shortest_prefixes(rows)
        if len(rows) <= MAX_TREE_BOUNDS:
            keys = [F.struct(*[F.col(c) for c in order[:m]]) for m in range(1, len(order) + 1)]
            bounds = [(m, _struct_lit(r[:m], fields[:m])) for r, m in zip(rows, prefixes)]
            tree = _bucket_tree(keys, bounds, 0, len(bounds))
            return cls(df, order, n, tree, len(bounds) + 1)
        # many buckets: binary search over one array literal of boundary keys,
        # each cut to its prefix and padded with nulls (smallest in key order)
        padded = [tuple(r[:m]) + (None,) * (len(order) - m) for r, m in zip(rows, prefixes)]
        key_type = df.select(key.alias("k")).schema["k"].dataType
        arr = array_literal(padded, key_type)
        steps = max(1, math.ceil(math.log2(len(rows) + 1)))
        return cls(df, order, n, None, len(rows) + 1, (arr, steps, len(rows)))

    def on(self, df: DataFrame, n_rows: int) -> "GlobalOrder":
        """The same boundaries over another table with the same order columns
        (any sorted boundary set is a valid range partition), without sampling again."""
        return GlobalOrder(df, self.order, n_rows, self.bucket, self.n_buckets, self.search)

    # ---- per-bucket facts -------------------------------------------------
    def with_bucket(self, df: DataFrame | None = None) -> DataFrame:
        d = df if df is not None else self.df
        if self.search is None:
            return d.withColumn(BUCKET, self.bucket)
        # bucket = number of boundaries <= key, by an unrolled binary search:
        # one small projection per step (log2 B steps), all inside code generation
        arr, steps, nb = self.search
        key = key_struct(self.order)
        d = d.withColumn("_lo", F.lit(0)).withColumn("_hi", F.lit(nb))
        for _ in range(steps):
            mid = ((F.col("_lo") + F.col("_hi") + 1) / 2).cast("int")
            below = key < F.element_at(arr, F.greatest(mid, F.lit(1)))
            go_left = (mid > F.col("_lo")) & below
            d = d.select("*", F.when(go_left, F.col("_lo")).otherwise(mid).alias("_lo2"),
                         F.when(go_left, mid - 1).otherwise(F.col("_hi")).alias("_hi2")) \
                .drop("_lo", "_hi").withColumnRenamed("_lo2", "_lo").withColumnRenamed("_hi2", "_hi")
        return d.withColumn(BUCKET, F.col("_lo")).drop("_lo", "_hi")

    def bucket_counts(self, df: DataFrame | None = None, where: Column | None = None) -> list[int]:
        d = self.with_bucket(df)
        if where is not None:
            d = d.filter(where)
        got = {r[0]: r[1] for r in d.groupBy(BUCKET).count().collect()}
        return [int(got.get(i, 0)) for i in range(self.n_buckets)]

    def local_window(self) -> Window:
        return Window.partitionBy(BUCKET).orderBy(*[F.col(c) for c in self.order])

    def dealt(self, d: DataFrame, only: Sequence[int] | None = None) -> DataFrame:
        """One task per bucket: rows go to the partition with their bucket's
        number, so the number of tasks follows the number of buckets and no two
        buckets meet in one task (hashing them would). Windows by bucket need no
        further exchange."""
        if self.n_buckets <= 1:
            return d
        if only is None:
            return d.repartitionById(self.n_buckets, F.col(BUCKET))
        place = F.col(BUCKET)
        if len(only) < self.n_buckets:
            numbers = array_literal(list(only), T.IntegerType())
            place = (F.array_position(numbers, F.col(BUCKET)) - 1).cast("int")
        return d.repartitionById(max(len(only), 1), place)

    # ---- positions --------------------------------------------------------
    def global_index(self, name: str = "_idx", counts: list[int] | None = None) -> DataFrame:
        """Every row with its 0-based position in the total order."""
        counts = counts if counts is not None else self.bucket_counts()
        offsets = _prefix(counts)
        offs = array_literal(offsets, T.LongType())
        d = self.dealt(self.with_bucket())
        return (d.withColumn(name, F.element_at(offs, F.col(BUCKET) + 1)
                             + F.row_number().over(self.local_window()) - 1)
                .drop(BUCKET))

    def select_positions(self, positions: Sequence[int], name: str = "_idx",
                         counts: list[int] | None = None) -> DataFrame:
        """Only the rows at the given 0-based positions; sorts only the buckets that hold them."""
        counts = counts if counts is not None else self.bucket_counts()
        offsets = _prefix(counts)
        wanted: dict[int, list[int]] = {}
        for p in sorted(set(int(x) for x in positions)):
            if p < 0 or p >= sum(counts):
                continue
            b = _find_bucket(offsets, counts, p)
            wanted.setdefault(b, []).append(p)
        if not wanted:
            return self.df.withColumn(name, F.lit(None).cast("bigint")).limit(0)
        d = self.with_bucket().filter(F.col(BUCKET).isin(list(wanted)))
        # only the wanted buckets move, each to a task of its own
        d = self.dealt(d, sorted(wanted))
        offs = array_literal(offsets, T.LongType())
        pos = F.element_at(offs, F.col(BUCKET) + 1) + F.row_number().over(self.local_window()) - 1
        flat = [p for ps in wanted.values() for p in ps]
        return d.withColumn(name, pos).filter(F.col(name).isin(flat)).drop(BUCKET)


def _prefix(counts: list[int]) -> list[int]:
    out, run = [], 0
    for c in counts:
        out.append(run)
        run += c
    return out


def _find_bucket(offsets: list[int], counts: list[int], p: int) -> int:
    lo, hi = 0, len(offsets) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if offsets[mid] <= p:
            lo = mid
        else:
            hi = mid - 1
    while counts[lo] == 0 or p >= offsets[lo] + counts[lo]:
        lo += 1
    return lo


# ---------------------------------------------------------------------------
# W1 forward fill
# ---------------------------------------------------------------------------

def forward_fill(df: DataFrame, cols: Sequence[str], order: Sequence[str] | str | None = None,
                 then: object | None = None, go: GlobalOrder | None = None) -> DataFrame:
    """``last(c, ignorenulls) OVER (ORDER BY order ROWS UNBOUNDED PRECEDING)``
    for every column in ``cols``, computed bucket by bucket; ``then`` fills
    what is still null (leading nulls)."""
    cols = list(cols)
    if not cols:
        return df
    go = go or GlobalOrder.build(df, order)
    key = ordering_key(df, go.order)
    d = go.with_bucket(df)
    # last non-null value of each column inside each bucket (B rows)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"_last{i}"))
    per_bucket = {r[BUCKET]: r for r in d.groupBy(BUCKET).agg(*aggs).collect()}
    w = go.local_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = go.dealt(d)
    for i, c in enumerate(cols):
        dtype = df.schema[c].dataType
        carry, carried = None, []
        for b in range(go.n_buckets):
            carried.append(carry)
            r = per_bucket.get(b)
            if r is not None and r[f"_last{i}"] is not None:
                carry = r[f"_last{i}"]
        arr = array_literal(carried, dtype)
        filled = F.coalesce(F.last(F.col(c), ignorenulls=True).over(w), F.element_at(arr, F.col(BUCKET) + 1))
        if then is not None:
            filled = F.coalesce(filled, F.lit(then).cast(dtype))
        out = out.withColumn(c, filled)
    return out.drop(BUCKET).select(*df.columns)
