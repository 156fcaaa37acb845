"""KPIs and the numeric column summary, each one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.frames import rows_frame

from ..functions.rules import Rule, rows_of
from ..functions.types import column_classes
from ..functions.words import KPI_MONEY_WORDS
from .profile import TableFacts, table_facts

KPI_SCHEMA = "kpi_order long, name string, value double, type string, icon string"
MAX_KPIS = 10


def _amount(title: str, measure: str, kind: str, icon: str):
    return lambda f: (f"{title} {f['column']}", round(f[measure], 2), kind, icon)


#: K1 as a table: subject, row, condition.
KPI_RULES = [
    Rule("table", lambda f: ("Total Records", float(f["rows"]), "count", "rows")),
    Rule("table", lambda f: ("Data Fields", float(f["fields"]), "count", "columns")),
    Rule("money", _amount("Total", "sum", "currency", "dollar")),
    Rule("money", _amount("Avg", "mean", "currency", "trending")),
    Rule("number", _amount("Total", "sum", "number", "sum")),
    Rule("text", lambda f: (f"Unique {f['column']}", float(f["unique"]), "count", "hash")),
]


def _numeric_kind(column: str, count: int) -> str:
    """Which rules a numeric column falls under; one without data under none."""
    return "empty" if not count else "money" if any(w in column.lower() for w in KPI_MONEY_WORDS) else "number"


def kpi_rows(df: DataFrame, numeric_k: int = 4, text_k: int = 2, approx: bool = False,
             facts: TableFacts | None = None) -> list[tuple]:
    """K1 as (name, value, type, icon) tuples, in order, at most 10."""
    cc = column_classes(df)
    num, text = cc.numeric[:numeric_k], cc.text[:text_k]
    f = facts if facts is not None and all(c in facts.distinct for c in text) else \
        table_facts(df.select(*num, *text), approx, distinct=text)
    subjects = [("table", {"rows": f.rows, "fields": len(cc.columns)})]
    subjects += [(_numeric_kind(c, f.count[c]), {"column": c, "sum": f.sum[c], "mean": f.mean[c]}) for c in num]
    subjects += [("text", {"column": c, "unique": f.unique(c)}) for c in text]
    return rows_of(KPI_RULES, subjects, MAX_KPIS)


def kpis(df: DataFrame, numeric_k: int = 4, text_k: int = 2, approx: bool = False,
         facts: TableFacts | None = None) -> DataFrame:
    """K1: ``Total Records``, ``Data Fields``; for the first 4 numeric columns
    holding data, ``Total c`` and ``Avg c`` (currency) when the name holds a
    money word, else ``Total c`` (number), rounded to 2; ``Unique c`` for the
    first 2 text columns; at most 10, in that order.

    Two aggregates over the table (ordinary measures; distinct counts alone);
    the at most 10 KPI rows are laid out from their single result rows."""
    rows = kpi_rows(df, numeric_k, text_k, approx, facts)
    return rows_frame(df.sparkSession, [(i, *r) for i, r in enumerate(rows)], KPI_SCHEMA)


def numeric_summary(df: DataFrame, k: int = 5, facts: TableFacts | None = None) -> DataFrame:
    """Total and average of the first ``k`` numeric columns, rounded to 2;
    columns without data are skipped. (position, name, total, average)."""
    num = column_classes(df).numeric[:k]
    schema = "position long, name string, total double, average double"
    if not num:
        return rows_frame(df.sparkSession, [], schema)
    f = facts or table_facts(df.select(*num), distinct=[])
    rows = [(i, c, round(f.sum[c], 2), round(f.mean[c], 2)) for i, c in enumerate(num) if f.count[c]]
    return rows_frame(df.sparkSession, rows, schema)
