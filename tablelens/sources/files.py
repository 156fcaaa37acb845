"""Loading a table by file suffix, CSV typed over all rows, and the
upload manifest of a folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import allowed_file, file_suffix, file_type
from ..functions.types import ORDER_MARK, WORKING_COLUMNS, order_columns
from ..functions.words import CLIENT_SUFFIXES
from .csv_splits import csv_records, has_quoted_breaks


def _free(columns: list[str], name: str) -> str:
    """``name``, with an underscore more until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def with_file_order(df: DataFrame, blocks: bool = False) -> DataFrame:
    """Hidden total order of a file scan, of one form at any size: the file's
    path and the place of the row in it.

    Parquet: (``_file``, ``_pos``) with the row index that the reader knows.
    Text formats have no row index: (``_file``, ``_block``, ``_pos``) — path,
    split start, and a counter that increases along each split (rows of a split
    are read in file order and stay together in one partition, so the triple
    follows the files even though Spark packs splits into partitions by size).
    ``blocks=True`` gives Parquet the triple too, for scans in physical order.

    A name that the table uses itself gets an underscore more; the added columns are
    marked in the schema, so the user's are analysed whatever their names (those
    of ``WORKING_COLUMNS`` are refused). A table that already carries marked order
    columns (a stored copy) keeps them.
    """
    if order_columns(df):
        return df
    taken = {c.lower() for c in df.columns}
    if taken & WORKING_COLUMNS:
        raise ValueError(f"rename the columns {sorted(taken & WORKING_COLUMNS)}: they are names of working columns")
    meta = F.col("_metadata")
    parts = [(_free(df.columns, "_file"), meta["file_path"]), (_free(df.columns, "_block"), meta["file_block_start"])]
    try:
        df.select(meta["row_index"])
        parts = (parts if blocks else parts[:1]) + [(_free(df.columns, "_pos"), meta["row_index"])]
    except AnalysisException:  # the format has no row index
        parts.append((_free(df.columns, "_pos"), F.monotonically_increasing_id()))
    return df.select("*", *[c.alias(name, metadata={ORDER_MARK: i}) for i, (name, c) in enumerate(parts)])


# types a text column may have, narrowest first: (type, fits)
_CSV_TYPES = [
    ("bigint", lambda v: v.rlike(r"^\s*[+-]?\d{1,18}\s*$")),
    ("double", lambda v: v.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")),
    ("boolean", lambda v: F.lower(v).isin("true", "false")),
    ("date", lambda v: v.rlike(r"^\d{4}-\d{2}-\d{2}$") & v.try_cast("date").isNotNull()),
    ("timestamp_ntz", lambda v: v.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")
     & v.try_cast("timestamp_ntz").isNotNull()),
]


def csv_types(raw: DataFrame) -> dict[str, str]:
    """The narrowest type that every cell of each text column fits, from one
    aggregate over all rows (all null: text)."""
    aggs = []
    for i, c in enumerate(raw.columns):
        v = F.col(f"`{c}`")
        aggs.append(F.count(v).alias(f"n{i}"))
        aggs += [F.count_if(v.isNotNull() & ~fits(v)).alias(f"{name}{i}") for name, fits in _CSV_TYPES]
    row = raw.agg(*aggs).first() if aggs else {}
    return {c: next((name for name, _ in _CSV_TYPES if row[f"n{i}"] and not row[f"{name}{i}"]), "string")
            for i, c in enumerate(raw.columns)}


#: Options under which the records of a CSV file can be found split by split.
_SPLIT_OPTIONS = {"sep", "delimiter"}
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def _typed(raw: DataFrame, names: list[str]) -> list:
    kinds = csv_types(raw.select(*[F.col(f"`{c}`") for c in names]))
    return [(F.col(f"`{c}`") if t == "string" else F.trim(F.col(f"`{c}`")).cast(t)).alias(c) for c, t in kinds.items()]


def _read_csv(spark: SparkSession, path: str, multi_line: bool | None, options: dict) -> DataFrame:
    """A typed CSV; read split by split it comes with its marked order columns."""
    sep = options.get("sep", options.get("delimiter", ","))
    probe = spark.read.options(header=True, inferSchema=False, escape='"', **options).csv(path)
    by_splits = set(options) <= _SPLIT_OPTIONS and multi_line is not False and not any(
        f.lower().endswith(_COMPRESSED) for f in probe.inputFiles())
    if by_splits and (multi_line or has_quoted_breaks(spark, path, sep)):
        names = spark.read.options(header=True, inferSchema=False, escape='"', multiLine=True, **options).csv(path).columns
        raw = csv_records(spark, path, [f"c{i}" for i in range(len(names))], sep).toDF("place", *[f"c{i}" for i in range(len(names))])
        typed = _typed(raw, raw.columns[1:])
        places = [F.col("place")[c].alias(_free(names, f"_{c}"), metadata={ORDER_MARK: i}) for i, c in enumerate(("file", "block", "pos"))]
        return raw.select(*[t.alias(n) for t, n in zip(typed, names)], *places)
    raw = spark.read.options(header=True, inferSchema=False, escape='"', multiLine=bool(multi_line), **options).csv(path)
    return raw.select(*_typed(raw, raw.columns))


def read_csv_table(spark: SparkSession, path: str, multi_line: bool | None = None, **options) -> DataFrame:
    """CSV with a header row, typed over **all** its rows (integer, float,
    Boolean, date, date-time, else text): a column takes the narrowest type that
    every cell fits, so no cell is lost to a type. Quotes are doubled inside
    quoted cells.

    Line breaks inside quoted cells: by default the lines with quotes are looked at,
    and files that have such breaks are read split by split (``csv_splits``), so a
    file is never one task. ``multi_line=False`` takes every line as a record;
    ``multi_line=True`` skips the look. Compressed files, and files read with other
    options than the separator, can't be cut: ``multi_line=True`` reads each in one task."""
    df = _read_csv(spark, path, multi_line, options)
    return df.drop(*order_columns(df))


def load_table(spark: SparkSession, path: str, blocks: bool = False, **options) -> DataFrame:
    """Dispatch by lower-cased suffix; an unknown suffix is an error. The table
    has the hidden file order of ``with_file_order`` (which see for ``blocks``)."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        df = _read_csv(spark, path, options.pop("multi_line", None), options)
    elif low.endswith(".parquet"):
        df = spark.read.options(**options).parquet(path)
    elif low.endswith(".json") or low.endswith(".jsonl"):
        df = spark.read.options(**options).json(path)
    else:
        suffix = "." + low.rsplit(".", 1)[-1] if "." in low.rsplit("/", 1)[-1] else ""
        raise ValueError(f"Unsupported file type: {suffix}")
    return with_file_order(df, blocks)


def file_manifest(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """S3: one upload row per file matching ``pattern``: id, filename,
    original_name, file_type, file_size, allowed, status, created_at, suffix,
    client_accepts (the browser widget offers no ``.doc``).
    The ``binaryFile`` source is asked for path, length and time only, so
    file contents are never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
             .load(pattern).select("path", "length", "modificationTime"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        F.substring(F.sha2(F.col("path"), 256), 1, 32).alias("id"),
        F.col("path").alias("filename"),
        name.alias("original_name"),
        file_type(name).alias("file_type"),
        F.col("length").cast("bigint").alias("file_size"),
        allowed_file(name).alias("allowed"),
        F.when(allowed_file(name), F.lit("uploaded")).otherwise(F.lit("rejected")).alias("status"),
        F.col("modificationTime").alias("created_at"),
        file_suffix(name).alias("suffix"),
        file_suffix(name).isin(CLIENT_SUFFIXES).alias("client_accepts"),
    )
