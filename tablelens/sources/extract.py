"""Tables from extracted document cells and lines.

Decoding PDF / Word bytes needs per-file libraries and is not done here;
these operators take what such an extractor produces, as DataFrames:
``cells(doc, table_no, row_no, col_no, text)`` and ``docs(doc, text)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import rows_frame

from ..functions.text import py_text_repr
from ..functions.words import EMPTY_DOCUMENT


def text_to_rows(docs: DataFrame, drop_blank: bool = False, doc_col: str = "doc",
                 text_col: str = "text") -> DataFrame:
    """One row per line of each document (doc, line_no, text).

    ``drop_blank=False`` keeps blank lines of a non-empty text (page text
    path); ``drop_blank=True`` drops lines that are blank (paragraph path).
    A document with no lines left becomes one row ``(empty document)``."""
    t = F.col(text_col)
    lines = F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))
    if drop_blank:
        lines = F.filter(lines, lambda ln: F.regexp_replace(ln, r"\s", "") != "")
    lines = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(EMPTY_DOCUMENT)))
    return docs.select(F.col(doc_col).alias("doc"), F.posexplode(lines).alias("line_no", "text")) \
        .withColumn("line_no", F.col("line_no").cast("bigint"))


def _with_headers(cells: DataFrame, docx: bool) -> DataFrame:
    """Cells with their document's header row, column names and width:
    ``_names`` (by column number), ``_header`` (is this cell in the header row).

    The header is the first row of a document's first table. Names are trimmed,
    missing or empty ones become ``col_{i}``, a repeated name gets ``_2``, ``_3``.
    DOCX documents have one table, the first, and trimmed cells."""
    at = F.struct("table_no", "row_no")
    first = cells.groupBy("doc").agg(F.min(at).alias("_first"))
    c = cells.join(first, "doc")
    if docx:
        c = c.where(F.col("table_no") == F.col("_first.table_no")).withColumn("text", F.trim("text"))
    c = c.withColumn("_header", at == F.col("_first")).drop("_first")
    head = c.where("_header").groupBy("doc").agg(
        F.max("col_no").alias("_last"), F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("_text"))
    raw = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(
        F.nullif(F.regexp_replace(F.element_at("_text", i), r"^\s+|\s+$", ""), F.lit("")),
        F.concat(F.lit("col_"), i.cast("string"))))
    head = head.withColumn("_raw", raw)
    unique = F.transform("_raw", lambda name, k: F.concat(name, F.when(
        F.size(F.filter(F.slice("_raw", 1, k), lambda x: x == name)) > 0,
        F.concat(F.lit("_"), (F.size(F.filter(F.slice("_raw", 1, k), lambda x: x == name)) + 1).cast("string")))
        .otherwise(F.lit(""))))
    return c.join(head.select("doc", unique.alias("_names")), "doc")


def _header_names(cells: dict[int, str | None]) -> list[str]:
    """The column names of one header row, by the rules of ``_with_headers``."""
    raw = [(cells.get(i) or "").strip(" \t\n\x0b\x0c\r") or f"col_{i}" for i in range(max(cells) + 1)]
    return [name if name not in raw[:i] else f"{name}_{raw[:i].count(name) + 1}" for i, name in enumerate(raw)]


def cells_to_records(cells: DataFrame, docx: bool = False) -> DataFrame:
    """S4 and U1 for any number of documents at once: one row per data row of
    every table of every document, in one table: (doc, table_no, row_no, record),
    ``record`` a map from the document's column names to cell texts. Short rows
    are padded with null, cells beyond the header are cut, a row all of whose
    cells were cut stays. A document with a header row only has no rows here
    (see ``cells_to_table``)."""
    c = _with_headers(cells, docx).where(~F.col("_header"))
    row = c.groupBy("doc", "table_no", "row_no").agg(
        F.first("_names").alias("_names"), F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("_cells"))
    entries = F.transform("_names", lambda name, i: F.struct(name, F.element_at("_cells", i.cast("bigint"))))
    return row.select("doc", "table_no", "row_no", F.map_from_entries(entries).alias("record"))


def cells_to_table(cells: DataFrame, doc: str | None = None, docx: bool = False) -> DataFrame:
    """The cells of one document as a table. The first row of the first
    table is the header (trimmed; missing or empty → ``col_{i}``; a repeated
    name gets a number); every other row of every table is data, in (table, row)
    order; short rows are padded with null, long rows cut. A document with fewer
    than two rows becomes a one-column table ``text``. ``docx=True``: the first
    table only, with trimmed cells. Cells of several documents are refused unless
    ``doc`` names one: their headers differ (``cells_to_records`` takes them all).

    The header is one row (collected); data rows are pivoted on the known
    column positions in one aggregate."""
    c = cells if doc is None else cells.filter(F.col("doc") == doc)
    if "doc" not in c.columns:
        c = c.withColumn("doc", F.lit(""))
    if doc is None and c.select("doc").distinct().limit(2).count() > 1:
        raise ValueError("cells of several documents: name one, or use cells_to_records")
    c = c.withColumn("col_no", F.col("col_no").cast("bigint"))
    first = c.agg(F.min(F.struct("table_no", "row_no")).alias("at")).first()["at"]
    if first is None:
        return rows_frame(c.sparkSession, [], "text string")
    if docx:
        c = c.where(F.col("table_no") == F.lit(first["table_no"])).withColumn("text", F.trim("text"))
    is_header = (F.col("table_no") == F.lit(first["table_no"])) & (F.col("row_no") == F.lit(first["row_no"]))
    # the header is one row: its names become literals, so the cells are not joined with it
    names = _header_names({r["col_no"]: r["text"] for r in c.where(is_header).select("col_no", "text").collect()})
    data = c.where(~is_header)
    if data.isEmpty():
        # one row: a ``text`` row as Python prints a list of cells
        rows = c.groupBy("table_no", "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", "text"))).alias("r"))
        return rows.select(F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: py_text_repr(x["text"])), ", "), F.lit("]")).alias("text"))
    # cells beyond the header are skipped inside the aggregate, so their rows stay
    wide = [F.first(F.when(F.col("col_no") == i, F.col("text")), ignorenulls=True).alias(f"_v{i}")
            for i in range(len(names))]
    full = data.groupBy("table_no", "row_no").agg(*wide)
    return full.select(F.col("table_no").alias("_table_no"), F.col("row_no").alias("_row_no"),
                       *[F.col(f"_v{i}").alias(names[i]) for i in range(len(names))])


def rows_in_order(table: DataFrame) -> DataFrame:
    """Number the rows of a ``cells_to_table`` result in table order (hidden
    ``_row_id``), through range buckets rather than a one-partition window."""
    from ..operators.order import GlobalOrder
    return GlobalOrder.build(table, ["_table_no", "_row_no"]).global_index("_row_id")
