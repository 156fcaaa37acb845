"""Date range filter, search, pages, mentions, preview."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import js_number_text, py_datetime_text
from ..functions.types import column_classes, order_columns
from .heads import read_first
from .order import GlobalOrder, default_order, typed_lit

#: Pages that end within so many rows are a top-k.
TOP_ROWS = 100_000
_FILLED = "_filled"


def parse_bound(text: str | None) -> str | None:
    """A ``YYYY-MM-DD`` bound, or None when missing or invalid (then ignored)."""
    if not text:
        return None
    try:
        return datetime.strptime(text, "%Y-%m-%d").strftime("%Y-%m-%d")
    except ValueError:
        return None


def _bound_lit(day: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.lit(day).cast("date")
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(day + " 00:00:00").cast("timestamp_ntz")
    return F.lit(day + " 00:00:00").cast("timestamp")


def filter_date_range(df: DataFrame, start: str | None = None, end: str | None = None,
                      date_col: str | None = None) -> DataFrame:
    """Keep rows whose first date column lies in [start, end], both
    optional and inclusive. The end bound is midnight, so later times on the
    end day are excluded. No date column or no valid bound → table unchanged.
    Bounds are typed like the column, so the filter reaches the Parquet scan."""
    date_col = date_col or next(iter(column_classes(df).date), None)
    if date_col is None:
        return df
    dtype = df.schema[date_col].dataType
    s, e = parse_bound(start), parse_bound(end)
    out = df
    if s:
        out = out.filter(F.col(date_col) >= _bound_lit(s, dtype))
    if e:
        out = out.filter(F.col(date_col) <= _bound_lit(e, dtype))
    return out


def _cell_text(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return js_number_text(c)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return py_datetime_text(c)
    if isinstance(dt, T.DateType):
        return py_datetime_text(c, is_date=True)
    return F.col(c).cast("string")


def _signs(dtype: T.DataType) -> set[str] | None:
    """The characters that a cell's lower-case text may hold (None: any)."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return set("0123456789.-+e" "nan" "infinity")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return set("0123456789-+:. ")
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return set("0123456789-")
    return None


def cell_texts(df: DataFrame) -> dict[str, Column]:
    """The text of each text, number and date cell, by column, as search sees it."""
    cc = column_classes(df)
    return {c: _cell_text(df, c) for c in cc.columns if c in cc.text or c in cc.numeric_wide or c in cc.date}


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows where any text, number or date cell contains ``text``,
    case-insensitive (numbers as the browser prints them, dates as text)."""
    low = text.lower()
    needle = F.lit(low)
    cond = F.lit(False)
    # cheap cells first; a column whose texts cannot hold the needle's characters is not looked at
    texts = {c: t for c, t in cell_texts(df).items() if set(low) <= (_signs(df.schema[c].dataType) or set(low))}
    for c in sorted(texts, key=lambda c: isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))):
        # an empty cell shows nothing, so it matches nothing
        cond = cond | (F.col(c).isNotNull() & F.coalesce(F.lower(texts[c]).contains(needle), F.lit(False)))
    return df.filter(cond)


def page(df: DataFrame, sort: str | None = None, descending: bool = False, page_no: int = 0,
         size: int = 15, order: Sequence[str] | str | None = None, top_rows: int = TOP_ROWS) -> DataFrame:
    """One page of ``size`` rows, sorted by ``sort`` (nulls first ascending,
    last descending; ties in table order), in page order.

    Up to ``top_rows`` rows a page is a top-k, whose heap holds offset + size
    rows in one task. Later pages are found by their positions instead: range
    buckets over (null flag, sort value, table order) sort only the buckets that
    hold them. Both ways give the same rows in the same order."""
    order = default_order(df, order)
    start = page_no * size
    if sort is None:
        sort, rest = order[0], list(order[1:])
        descending = False
    else:
        rest = [c for c in order if c != sort]
    keys = [F.col(sort).desc() if descending else F.col(sort).asc(), *[F.col(c).asc() for c in rest]]
    if start + size <= top_rows:
        ordered = df.orderBy(*keys)
        return ordered.offset(start).limit(size) if start else ordered.limit(size)
    go = GlobalOrder.build(df.withColumn(_FILLED, F.col(sort).isNotNull()), [_FILLED, sort, *rest])
    counts = go.bucket_counts()
    wanted = range(start, min(start + size, sum(counts)))
    if descending:
        wanted = _from_the_end(go, counts, sort, wanted)
    return go.select_positions(wanted, counts=counts).orderBy(*keys).drop("_idx", _FILLED)


def _from_the_end(go: GlobalOrder, counts: list[int], sort: str, wanted: range) -> list[int]:
    """Ascending positions of the rows at descending positions ``wanted``. Equal
    sort values keep their table order both ways, so a row's place within its
    group of equal values is the same; the group itself is mirrored."""
    n = sum(counts)
    mirrored = {n - 1 - p: p for p in wanted}
    if not mirrored:
        return []
    values = {r["_idx"]: r[sort] for r in go.select_positions(list(mirrored), counts=counts).select("_idx", sort).collect()}
    groups = list(dict.fromkeys(values.values()))          # at most one per row of the page
    dtype = go.df.schema[sort].dataType
    aggs = []
    for i, v in enumerate(groups):
        lower = F.lit(False) if v is None else ~F.col(_FILLED) | (F.col(sort) < typed_lit(v, dtype))
        equal = ~F.col(_FILLED) if v is None else F.col(sort) == typed_lit(v, dtype)
        aggs += [F.count_if(lower).alias(f"low{i}"), F.count_if(equal).alias(f"same{i}")]
    row = go.df.agg(*aggs).first()
    out = []
    for i, p in mirrored.items():
        g = groups.index(values[i])
        low, same = row[f"low{g}"], row[f"same{g}"]
        out.append(low + p - (n - low - same))
    return out


def preview(df: DataFrame, order: Sequence[str] | str | None = None, n: int = 50) -> DataFrame:
    """The first ``n`` rows in table order (a top-k; of a table in the loader's
    file order, over the first files that hold them)."""
    order = default_order(df, order)
    if order == order_columns(df):
        return read_first(df, n).rows
    return df.orderBy(*[F.col(c).asc() for c in order]).limit(n)


def clean_question(col: Column | str) -> Column:
    """Drop ``@mention`` tokens and repeated blanks; an empty result
    falls back to the trimmed raw text."""
    c = F.col(col) if isinstance(col, str) else col
    raw = F.regexp_replace(c, r"^\s+|\s+$", "")
    cleaned = F.regexp_replace(F.regexp_replace(raw, r"(^|\s)@\S+", " "), r"\s+", " ")
    cleaned = F.regexp_replace(cleaned, r"^\s+|\s+$", "")
    return F.when(cleaned == "", raw).otherwise(cleaned)


def match_uploads(uploads: DataFrame, query: str, n: int = 8, name_col: str = "original_name",
                  newest_first: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """Uploads whose name contains ``query`` (case-insensitive), first ``n``
    in list order (newest first)."""
    hit = uploads.filter(F.lower(F.col(name_col)).contains(query.lower()))
    return hit.orderBy(*[F.col(c).desc() for c in newest_first]).limit(n)
