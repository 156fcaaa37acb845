"""M3–M5: derived profit, average price and margin, with their KPIs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .domain import map_metrics


def _ratio(a: Column, b: Column) -> Column:
    """a / b, where a divisor of 0 counts as 1."""
    return a / F.when(b == 0, F.lit(1)).otherwise(b)


@dataclass(frozen=True)
class Derived:
    """A column made of two others, and the aggregate that is its KPI. A need
    names a metric kind, or with ``=`` a column of exactly that name."""

    name: str
    needs: tuple[str, str]
    value: Callable[[Column, Column], Column]
    kpi: Callable[[Column], Column]


#: M3, M4, M5, each seeing the columns made before it.
DERIVED = [
    Derived("profit", ("revenue", "cost"), lambda a, b: a - b, lambda c: F.coalesce(F.sum(c), F.lit(0.0))),
    Derived("avg_price", ("revenue", "quantity"), _ratio, F.avg),
    Derived("margin", ("=profit", "revenue"), _ratio, F.avg),
]


def derive_metrics(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``profit = revenue − cost`` (when both are mapped),
    ``avg_price = revenue / quantity`` (quantity 0 → 1) and
    ``margin = profit / revenue`` (revenue 0 → 1; profit may be given).
    The first mapped column of each kind is used. Returns the table and one
    KPI row (profit sum, avg_price mean, margin mean; null when not derived)."""
    kinds = map_metrics(df.columns)
    source = {kind: name for name, kind in reversed(list(kinds.items()))}   # the first column of a kind
    made: dict[str, Column] = {}
    out = df
    for rule in DERIVED:
        source.update({f"={c}": c for c in out.columns})
        if all(need in source for need in rule.needs):
            out = out.withColumn(rule.name, rule.value(*[F.col(source[need]) for need in rule.needs]))
            made[rule.name] = rule.kpi(F.col(rule.name))
    return out, out.agg(*[made.get(r.name, F.lit(None)).cast("double").alias(r.name) for r in DERIVED])
