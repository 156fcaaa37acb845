"""C4: column classes, read from the schema in column order (no job).

Hidden columns are the library's own bookkeeping (row order, copy numbers). The
loader marks the order columns it adds in the schema's metadata, under names the
file does not use; in a table with marked columns exactly those are hidden. A table
without marks hides an explicit list of names. Every other column is the
user's, whatever its name starts with, and is analysed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import rows_frame

#: The bookkeeping columns of this library: file order, table and row numbers of
#: extracted cells, copy numbers, and positions. No other column is hidden.
HIDDEN_COLUMNS = frozenset({"_row_id", "_file", "_block", "_pos", "_table_no", "_row_no", "_copy", "_idx", "_bucket"})

#: Names that the order-dependent operators use for their working columns; the
#: loader refuses a file that has one of them rather than overwrite it.
WORKING_COLUMNS = frozenset({"_idx", "_bucket", "_lo", "_hi", "_lo2", "_hi2", "_first", "_filled", "_metadata"})

#: Metadata key of a marked order column; its value is the column's place in the order.
ORDER_MARK = "tablelens.order"

# numeric: KPIs, charts, insights, anomalies, prompt context
NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)
# numeric-wide: null filling and column statistics also take the small integers
NUMERIC_WIDE_TYPES = NUMERIC_TYPES + (T.ShortType, T.ByteType)
TEXT_TYPES = (T.StringType, T.VarcharType, T.CharType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def order_columns(df: DataFrame) -> list[str]:
    """The marked order columns, in their order."""
    marked = [(f.metadata[ORDER_MARK], f.name) for f in df.schema.fields if f.metadata and ORDER_MARK in f.metadata]
    return [name for _, name in sorted(marked)]


def hidden_columns(df: DataFrame) -> frozenset[str]:
    return frozenset(order_columns(df)) or HIDDEN_COLUMNS


def with_marks_of(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` with the marks that ``source`` has on columns of the same names
    (an aggregate's result loses them)."""
    for place, c in enumerate(order_columns(source)):
        if c in df.columns:
            df = df.withMetadata(c, {ORDER_MARK: place})
    return df


def data_columns(df: DataFrame) -> list[str]:
    hidden = hidden_columns(df)
    return [c for c in df.columns if c not in hidden]


def _is(dt: T.DataType, kinds: tuple) -> bool:
    return isinstance(dt, kinds)


@dataclass(frozen=True)
class ColumnClasses:
    columns: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    numeric_wide: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    date: list[str] = field(default_factory=list)
    dtypes: dict[str, T.DataType] = field(default_factory=dict)


def column_classes(df: DataFrame) -> ColumnClasses:
    cols, num, wide, text, date, dtypes = [], [], [], [], [], {}
    hidden = hidden_columns(df)
    for f in df.schema.fields:
        if f.name in hidden:
            continue
        cols.append(f.name)
        dtypes[f.name] = f.dataType
        if _is(f.dataType, NUMERIC_TYPES):
            num.append(f.name)
        if _is(f.dataType, NUMERIC_WIDE_TYPES):
            wide.append(f.name)
        if _is(f.dataType, TEXT_TYPES):
            text.append(f.name)
        if _is(f.dataType, DATE_TYPES):
            date.append(f.name)
    return ColumnClasses(cols, num, wide, text, date, dtypes)


def is_numeric(dt: T.DataType) -> bool:
    return _is(dt, NUMERIC_TYPES)


def is_numeric_wide(dt: T.DataType) -> bool:
    return _is(dt, NUMERIC_WIDE_TYPES)


def is_text(dt: T.DataType) -> bool:
    return _is(dt, TEXT_TYPES)


def is_date(dt: T.DataType) -> bool:
    return _is(dt, DATE_TYPES)


def column_classes_table(df: DataFrame) -> DataFrame:
    """C4 as a DataFrame: (position, column, dtype, class) in column order."""
    spark = df.sparkSession
    cc = column_classes(df)
    rows = []
    for i, c in enumerate(cc.columns):
        dt = cc.dtypes[c]
        klass = "numeric" if is_numeric(dt) else "numeric_wide" if is_numeric_wide(dt) else \
            "text" if is_text(dt) else "date" if is_date(dt) else "other"
        rows.append((i, c, dt.simpleString(), klass))
    return rows_frame(spark, rows, "position long, column string, dtype string, class string")
