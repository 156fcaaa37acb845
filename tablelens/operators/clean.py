"""Cleaning a messy table, with a report of what changed.

``clean_table`` runs them in the application's order: text → number, null
filling, whole-row de-duplication, anomaly counts. Values that fail the
number conversion become null and are then filled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import rows_frame

from ..functions.text import parses_as_python_float, to_number
from ..functions.types import column_classes, data_columns, order_columns, with_marks_of
from ..functions.words import EMPTY_TEXT
from .heads import head_values, read_heads
from .order import GlobalOrder, default_order, forward_fill

_HASH = "_row_hash"
REPORT_SCHEMA = "column string, action string, affected_rows bigint"


def report_frame(spark, rows: list[tuple[str, str, int]]) -> DataFrame:
    """A report keeps only lines with a positive count."""
    return rows_frame(spark, [r for r in rows if r[2] > 0], REPORT_SCHEMA)


# ---------------------------------------------------------------------------
# C1
# ---------------------------------------------------------------------------

def numeric_decisions(df: DataFrame, order: Sequence[str] | str | None = None,
                      sample: int = 50, threshold: float = 0.7) -> dict[str, tuple[int, int, bool]]:
    """For every text column: (sample size, values that parse, convert?).

    The sample is the first ``sample`` non-null values in table order; a value
    counts when Python's float() would accept it after ``$ , %`` and blanks at
    both ends are dropped. Convert when parsed > threshold × sample (strict).
    All-null columns have no sample and are skipped.
    """
    order = default_order(df, order)
    text = column_classes(df).text
    if not text:
        return {}
    # in the loader's file order the first files that hold the sample are enough
    heads = read_heads(df, text, sample).rows if order == order_columns(df) else head_values(df, text, order, sample)
    stats = (heads.groupBy("column")
             .agg(F.count(F.lit(1)).alias("n"), F.count_if(parses_as_python_float("value")).alias("ok"))
             .collect())
    out = {}
    for r in stats:
        out[r["column"]] = (int(r["n"]), int(r["ok"]), r["ok"] > r["n"] * threshold)
    return out


def coerce_numeric(df: DataFrame, order: Sequence[str] | str | None = None, sample: int = 50,
                   threshold: float = 0.7, decisions: dict | None = None) -> DataFrame:
    """Text columns that look numeric become doubles; values that do not
    parse become null (so do NaN and infinities). Column order is kept.

    The application's report line for this step can never appear (its count is
    floored at zero and zero lines are dropped), so none is produced.
    """
    decisions = decisions if decisions is not None else numeric_decisions(df, order, sample, threshold)
    convert = [c for c, d in decisions.items() if d[2]]
    if not convert:
        return df
    return df.withColumns({c: to_number(c) for c in convert})


# ---------------------------------------------------------------------------
# C2
# ---------------------------------------------------------------------------

def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, int]:
    cols = list(cols) if cols is not None else data_columns(df)
    if not cols:
        return {}
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return {c: int(row[f"n{i}"]) for i, c in enumerate(cols)}


def fill_missing(df: DataFrame, order: Sequence[str] | str | None = None,
                 nulls: dict[str, int] | None = None,
                 go: GlobalOrder | None = None) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """Numeric columns (with the small integers) are forward-filled in
    table order, then leading nulls become 0; text nulls become ``(empty)``;
    other types are left alone. Returns the table and report lines."""
    order = default_order(df, order)
    cc = column_classes(df)
    n_rows = None
    if nulls is None:
        row = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cc.columns)]).first()
        n_rows = int(row["_rows"])
        nulls = {c: int(row[f"n{i}"]) for i, c in enumerate(cc.columns)}
    report, ffill, text_fill = [], [], []
    for c in cc.columns:
        n = nulls.get(c, 0)
        if n == 0:
            continue
        if c in cc.numeric_wide:
            ffill.append(c)
            report.append((c, "filled_numeric_nulls", n))
        elif c in cc.text:
            text_fill.append(c)
            report.append((c, "filled_text_nulls", n))
    out = df
    if text_fill:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(EMPTY_TEXT)) for c in text_fill})
    if ffill:
        go = go or GlobalOrder.build(df, order, n_rows=n_rows)
        out = forward_fill(out, ffill, order, then=0, go=go)
    return out, report


def missing_report(df: DataFrame, nulls: dict[str, int] | None = None) -> list[tuple[str, str, int]]:
    """C2's report lines alone (one aggregate of null counts, no filling)."""
    cc = column_classes(df)
    nulls = nulls if nulls is not None else null_counts(df, cc.columns)
    out = []
    for c in cc.columns:
        n = nulls.get(c, 0)
        if n and c in cc.numeric_wide:
            out.append((c, "filled_numeric_nulls", n))
        elif n and c in cc.text:
            out.append((c, "filled_text_nulls", n))
    return out


# ---------------------------------------------------------------------------
# A1
# ---------------------------------------------------------------------------

def drop_duplicate_rows(df: DataFrame, order: Sequence[str] | str | None = None) -> DataFrame:
    """A1: whole-row duplicates (nulls equal) removed; the copy first in table
    order survives. An aggregate that is partial on the map side, so a row
    that repeats millions of times shrinks before the shuffle (hash-based for
    a single fixed-width order column, sort-based for a composite one)."""
    order = default_order(df, order)
    data = data_columns(df)
    # the surviving copy keeps all its hidden columns, those of the order first
    own = [c for c in df.columns if c not in data]
    hidden = [c for c in order if c in own] + [c for c in own if c not in order]
    if not hidden:
        return df.dropDuplicates(data)
    fixed_width = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                   T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    if len(hidden) == 1 and hidden[0] in order and isinstance(df.schema[hidden[0]].dataType, fixed_width):
        # one fixed-width key: a hash aggregate with a map-side partial min
        return with_marks_of(df.groupBy(*data).agg(F.min(hidden[0]).alias(hidden[0])).select(*df.columns), df)
    # a composite key: min over a struct (Spark plans a sort-based aggregate, still partial first)
    first = F.min(F.struct(*[F.col(c) for c in hidden])).alias("_first")
    grouped = df.groupBy(*data).agg(first)
    out = grouped.select(*[F.col("_first")[c].alias(c) if c in hidden else F.col(f"`{c}`") for c in df.columns])
    return with_marks_of(out, df)


#: Hashes of repeated rows that are sent to all tasks at most (8 bytes each).
REPEATED_HASHES = 2_000_000


def _flat_type(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType)) and dt.typeName() not in ("variant",)


def row_hash(df: DataFrame, cols: Sequence[str]):
    """64 bits of the columns, equal for rows that grouping takes as equal (nulls,
    and zeros of either sign)."""
    def one(c):
        col = F.col(f"`{c}`")
        return col + F.lit(0.0).cast(df.schema[c].dataType) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else col

    # the places of the nulls too: hashing leaves nulls out
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in cols])
    return F.xxhash64(*[one(c) for c in cols], nulls)


def drop_duplicate_rows_by_hash(df: DataFrame, order: Sequence[str] | str | None = None, hash_of=row_hash,
                                most: int = REPEATED_HASHES) -> DataFrame:
    """A1 for wide tables: the same rows as ``drop_duplicate_rows`` (a lone negative
    zero keeps its sign here). Only a hash of
    each row is shuffled first. A row whose hash occurs once has no duplicate and
    stays where it is; only rows with a repeated hash are shuffled and compared
    whole, so two rows that share a hash by chance both stay.

    The repeated hashes go to all tasks while they are at most ``most``; with more of
    them the table is mostly copies, and ``drop_duplicate_rows`` takes it (partial
    aggregates before its shuffle). So it does with nested columns."""
    order = default_order(df, order)
    data = data_columns(df)
    if not data or not all(_flat_type(df.schema[c].dataType) for c in data):
        return drop_duplicate_rows(df, order)
    hashed = df.select("*", hash_of(df, data).alias(_HASH))
    repeated = hashed.groupBy(_HASH).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(_HASH).alias("_again"))
    if repeated.limit(most + 1).count() > most:
        return drop_duplicate_rows(df, order)
    joined = hashed.join(F.broadcast(repeated), F.col(_HASH) == F.col("_again"), "left")
    columns = [F.col(f"`{c}`") for c in df.columns]
    single = joined.where("_again is null").select(*columns)
    again = drop_duplicate_rows(with_marks_of(joined.where("_again is not null").select(*columns), df), order)
    return with_marks_of(single.union(again), df)


# ---------------------------------------------------------------------------
# A2
# ---------------------------------------------------------------------------

def anomaly_stats(df: DataFrame, facts=None) -> dict[str, tuple[int, float | None, float | None]]:
    num = column_classes(df).numeric
    if facts is not None:
        return {c: (facts.count[c], facts.mean[c], facts.std[c]) for c in num}
    if not num:
        return {}
    aggs = []
    for i, c in enumerate(num):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (int(row[f"n{i}"]), row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(num)}


def anomaly_columns(stats: dict, min_rows: int = 10) -> list[tuple[str, float, float]]:
    """Columns A2 looks at: ≥ ``min_rows`` values and a non-zero sample deviation."""
    return [(c, m, s) for c, (n, m, s) in stats.items() if n >= min_rows and s not in (None, 0.0) and m is not None]


def z_score(c: str, mean: float, std: float):
    """|x − mean| / std with the mean and deviation of an earlier pass as literals."""
    return F.abs(F.col(c).cast("double") - F.lit(mean)) / F.lit(std)


def anomaly_counts(df: DataFrame, z: float = 3.0, min_rows: int = 10,
                   stats: dict | None = None) -> list[tuple[str, str, int]]:
    """A2: per numeric column with ≥ ``min_rows`` values and a non-zero sample
    deviation, the number of values with |x − mean| / std > ``z``. Rows stay."""
    stats = stats if stats is not None else anomaly_stats(df)
    use = anomaly_columns(stats, min_rows)
    if not use:
        return []
    row = df.agg(*[F.count_if(z_score(c, m, s) > z).alias(f"a{i}") for i, (c, m, s) in enumerate(use)]).first()
    return [(c, "anomalies_detected", int(row[f"a{i}"])) for i, (c, _, _) in enumerate(use)]


def anomaly_report(df: DataFrame, z: float = 3.0, min_rows: int = 10) -> DataFrame:
    return report_frame(df.sparkSession, anomaly_counts(df, z, min_rows))


def flag_anomalies(df: DataFrame, z: float = 3.0, min_rows: int = 10) -> DataFrame:
    """The rows A2 counts, with the column that flagged them (one row per flag)."""
    use = anomaly_columns(anomaly_stats(df), min_rows)
    spark = df.sparkSession
    if not use:
        return rows_frame(spark, [], T.StructType(df.schema.fields + [T.StructField("anomaly_column", T.StringType()), T.StructField("z_score", T.DoubleType())]))
    # one scan: the flags of a row as an array, then one row per flag
    flags = F.filter(F.array(*[F.struct(F.lit(c).alias("anomaly_column"), z_score(c, m, s).alias("z_score"))
                               for c, m, s in use]), lambda f: f["z_score"] > z)
    return df.select("*", F.inline(flags))


# ---------------------------------------------------------------------------
# C1 → C2 → A1 → A2
# ---------------------------------------------------------------------------

@dataclass
class Cleaned:
    table: DataFrame
    report: DataFrame
    order: list[str]
    rows_before: int
    rows_after: int
    facts: object = None
    path: str | None = None
    counts: dict = None
    buckets: object = None          # the range buckets built for the fill, if any

    @classmethod
    def of(cls, table: DataFrame, order: Sequence[str] | str | None = None) -> "Cleaned":
        """An already cleaned table, for instance one stored earlier."""
        return cls(table, report_frame(table.sparkSession, []), default_order(table, order), -1, -1, None, None, {})

    def release(self) -> bool:
        """Delete the written copy of the cleaned table (when ``persist`` wrote one)."""
        from ..session import release
        done = release(self.table.sparkSession, self.path)
        self.path = None
        return done


def clean_table(df: DataFrame, order: Sequence[str] | str | None = None, sample: int = 50,
                threshold: float = 0.7, z: float = 3.0, persist: bool = True,
                extra_counts=None, approx: bool = False, report: bool = True,
                distinct: bool = False) -> Cleaned:
    """Clean a table as the application does and return it with its report.

    With ``persist`` the cleaned table is written to the shared checkpoint
    folder once, so the later passes of an analysis read it instead of
    recomputing the fill and the de-duplication (and survive executor loss).
    ``approx`` counts distinct values with HyperLogLog++ sketches.
    ``report=False`` stops after the cleaning itself (no statistics or
    anomaly passes): for callers that only need the cleaned rows.
    ``distinct=True`` also counts distinct values of every column in the
    statistics pass (a full analysis needs them; the report does not).
    """
    from ..session import materialize

    order = default_order(df, order)
    spark = df.sparkSession
    t = coerce_numeric(df, order, sample, threshold)
    cols = data_columns(t)
    # pass 1: null counts and row count together
    row = t.agg(F.count(F.lit(1)).alias("_rows"),
                *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    rows_before = int(row["_rows"])
    nulls = {c: int(row[f"n{i}"]) for i, c in enumerate(cols)}
    go = None
    cc = column_classes(t)
    if any(nulls[c] > 0 for c in cc.numeric_wide):
        go = GlobalOrder.build(t, order, n_rows=rows_before)
    t, lines = fill_missing(t, order, nulls=nulls, go=go)
    t = drop_duplicate_rows(t, order)
    path = None
    if persist:
        t, path = materialize(t)
    if not report:
        return Cleaned(t, report_frame(spark, lines), order, rows_before, -1, None, path, {}, go)
    # pass 4: every per-column measure of the cleaned table at once (row count included)
    from .profile import table_facts
    facts = table_facts(t, approx, distinct=None if distinct else [])
    rows_after = facts.rows
    lines.append(("*", "removed_duplicates", rows_before - rows_after))
    # pass 5: anomaly counts, with any other counts the caller needs over the same scan
    use = anomaly_columns(anomaly_stats(t, facts))
    # ``extra_counts(table, facts)`` may add named conditions to count in the same scan
    extra = dict(extra_counts(t, facts)) if extra_counts is not None else {}
    aggs = [F.count_if(z_score(c, m, s) > z).alias(f"a{i}") for i, (c, m, s) in enumerate(use)]
    aggs += [F.count_if(cond).alias(f"x{j}") for j, cond in enumerate(extra.values())]
    got = {}
    if aggs:
        row = t.agg(*aggs).first()
        lines += [(c, "anomalies_detected", int(row[f"a{i}"])) for i, (c, _, _) in enumerate(use)]
        got = {name: int(row[f"x{j}"]) for j, name in enumerate(extra)}
    cleaned = Cleaned(t, report_frame(spark, lines), order, rows_before, rows_after, facts, path, {}, go)
    cleaned.counts = got
    return cleaned
