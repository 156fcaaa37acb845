"""Daily fact cube (B2, K1, A3): a date range merges days instead of rows.

One pass over the cleaned table keeps, per day of its first date column, partial
aggregates that merge: counts, sums, means, squared deviations, least and
greatest values, and two sketches per column as binary values (HyperLogLog for
distinct values, KLL for quantiles). Columns named ``exact`` also keep their
distinct values per day, so their distinct counts are exact for any range.

The end bound of a range is midnight (C3), so a day has two rows at most: what is
exactly at midnight, and the rest. Rows without a date are a row of their own, which
only an unbounded range takes.

Rows that come later are appended as further partial rows of their days;
``compact`` merges them.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import rows_frame
from ..functions.types import column_classes
from ..session import ensure_checkpoint_dir, release
from .explore import parse_bound
from .kpi import kpis
from .profile import TableFacts, column_statistics

#: HyperLogLog of 2**14 registers: relative error of a distinct count about 0.8 % (one standard error).
HLL_BITS = 14
#: KLL: rank error of a quantile at most about 0.7 % (at 99 % confidence).
KLL_SIZE = 400


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


@dataclass
class DayCube:
    """A stored cube: ``path`` holds the folders ``days`` and ``values``, and ``layout``."""

    spark: SparkSession
    path: str
    date_col: str
    exact: list[str]
    schema: T.StructType
    sketches: bool = True
    columns: list[str] = field(default_factory=list)

    # ---- layout -----------------------------------------------------------
    def __post_init__(self):
        self._empty = rows_frame(self.spark, [], self.schema)
        self.classes = column_classes(self._empty)
        self.columns = self.classes.columns

    def _days(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/days")

    def _values(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/values")

    def release(self) -> bool:
        """Delete the stored cube."""
        return release(self.spark, self.path)

    # ---- building ---------------------------------------------------------
    def _day_columns(self) -> list[Column]:
        d = F.col(f"`{self.date_col}`")
        midnight = F.lit(True) if isinstance(self.schema[self.date_col].dataType, T.DateType) else d == F.date_trunc("day", d)
        return [F.to_date(d).alias("day"), F.coalesce(midnight, F.lit(True)).alias("midnight")]

    def append(self, df: DataFrame) -> "DayCube":
        """Add the rows of ``df`` (cleaned rows that the cube does not hold yet)."""
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(self.columns):
            col = F.col(f"`{c}`")
            aggs.append(F.count(col).alias(f"n{i}"))
            if c in self.classes.numeric_wide:
                x = col.cast("double")
                aggs += [F.sum(x).alias(f"t{i}"), F.avg(x).alias(f"m{i}"), (F.var_pop(x) * F.count(x)).alias(f"v{i}"),
                         F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
                if self.sketches:
                    aggs.append(F.kll_sketch_agg_double(x, KLL_SIZE).alias(f"k{i}"))
            if self.sketches and c not in self.exact:
                aggs.append(F.hll_sketch_agg(_text(c), HLL_BITS).alias(f"h{i}"))
        day = self._day_columns()
        daily = df.groupBy(*day).agg(*aggs)
        daily.repartition(1).sortWithinPartitions("day").write.mode("append").parquet(f"{self.path}/days")   # two rows a day at most
        if self.exact:
            pairs = F.explode(F.array(*[F.struct(F.lit(self.columns.index(c)).alias("c"), _text(c).alias("value")) for c in self.exact]))
            values = df.select(*day, pairs.alias("p")).where("p.value is not null") \
                .groupBy("day", "midnight", "p.c", "p.value").agg(F.count(F.lit(1)).alias("n"))
            values.repartitionByRange("day", "c", "value").sortWithinPartitions("day", "c", "value") \
                .write.mode("append").parquet(f"{self.path}/values")
        return self

    def compact(self) -> "DayCube":
        """Merge the partial rows of each day into one (a new cube; release the old one)."""
        d = self._days()
        key = [F.col("day"), F.col("midnight")]
        means = d.groupBy(*key).agg(*[(F.sum(f"t{i}") / F.sum(F.when(F.col(f"t{i}").isNotNull(), F.col(f"n{i}")))).alias(f"mean{i}")
                                      for i in self._wide()])
        means = means.select(F.col("day").alias("day2"), F.col("midnight").alias("midnight2"), *[f"mean{i}" for i in self._wide()])
        joined = d.join(means, F.col("day").eqNullSafe(F.col("day2")) & (F.col("midnight") == F.col("midnight2")))
        aggs = [F.sum("rows").alias("rows")]
        for i, c in enumerate(self.columns):
            aggs.append(F.sum(f"n{i}").alias(f"n{i}"))
            if c in self.classes.numeric_wide:
                aggs += [F.sum(f"t{i}").alias(f"t{i}"), F.first(f"mean{i}").alias(f"m{i}"), _merged(i, F.col(f"mean{i}")).alias(f"v{i}"),
                         F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}")]
                if self.sketches:
                    aggs.append(F.kll_merge_agg_double(f"k{i}").alias(f"k{i}"))
            if self.sketches and c not in self.exact:
                aggs.append(F.hll_union_agg(f"h{i}").alias(f"h{i}"))
        new = _new_cube(self.spark, None, self.date_col, self.exact, self.schema, self.sketches)
        joined.groupBy(*key).agg(*aggs).repartition(1).sortWithinPartitions("day").write.parquet(f"{new.path}/days")
        if self.exact:
            self._values().groupBy("day", "midnight", "c", "value").agg(F.sum("n").alias("n")) \
                .repartitionByRange("day", "c", "value").sortWithinPartitions("day", "c", "value").write.parquet(f"{new.path}/values")
        return new

    # ---- ranges -----------------------------------------------------------
    def _wide(self) -> list[int]:
        return [i for i, c in enumerate(self.columns) if c in self.classes.numeric_wide]

    def within(self, rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
        """The rows of ``days`` or ``values`` in [start, end], both inclusive; the end is midnight."""
        s, e = parse_bound(start), parse_bound(end)
        if s:
            rows = rows.filter(F.col("day") >= F.lit(s).cast("date"))
        if e:
            last = F.lit(e).cast("date")
            rows = rows.filter(F.col("day") <= last).filter((F.col("day") < last) | F.col("midnight"))
        return rows

    def facts(self, start: str | None = None, end: str | None = None, distinct: Sequence[str] | None = None) -> TableFacts:
        """Every measure of a range, merged from its days: sums and counts, then the
        squared deviations around the merged mean (Chan's formula for many parts).
        Distinct counts: exact for ``exact`` columns, else of the merged sketches."""
        distinct = self.columns if distinct is None else list(distinct)
        d = self.within(self._days(), start, end)
        wide = self._wide()
        aggs = [F.sum("rows").alias("rows")]
        for i, c in enumerate(self.columns):
            aggs.append(F.sum(f"n{i}").alias(f"n{i}"))
            if i in wide:
                aggs += [F.sum(f"t{i}").alias(f"t{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}")]
            if c in distinct and c not in self.exact:
                if not self.sketches:
                    raise ValueError(f"the cube has neither values nor a sketch of {c}")
                aggs.append(F.hll_sketch_estimate(F.hll_union_agg(f"h{i}")).alias(f"d{i}"))
        row = d.agg(*aggs).first()
        count = {c: int(row[f"n{i}"] or 0) for i, c in enumerate(self.columns)}
        mean = {i: row[f"t{i}"] / count[self.columns[i]] if count[self.columns[i]] else None for i in wide}
        spread = d.agg(F.count(F.lit(1)), *[_merged(i, F.lit(mean[i]).cast("double")).alias(f"v{i}") for i in wide]).first()
        std = {i: math.sqrt(spread[f"v{i}"] / (count[self.columns[i]] - 1)) if count[self.columns[i]] > 1 else None for i in wide}
        found = {c: int(row[f"d{i}"] or 0) for i, c in enumerate(self.columns) if c in distinct and c not in self.exact}
        exact = [c for c in distinct if c in self.exact]
        if exact:
            values = self.within(self._values(), start, end).where(F.col("c").isin([self.columns.index(c) for c in exact]))
            got = {r["c"]: int(r["k"]) for r in values.groupBy("c").agg(F.count_distinct("value").alias("k")).collect()}
            found.update({c: got.get(self.columns.index(c), 0) for c in exact})
        rows = int(row["rows"] or 0)

        def pick(prefix):
            return {self.columns[i]: row[f"{prefix}{i}"] for i in wide}

        return TableFacts(rows, self.columns, {c: rows - count[c] for c in self.columns}, count, pick("t"),
                          {self.columns[i]: mean[i] for i in wide}, pick("lo"), pick("hi"),
                          {self.columns[i]: std[i] for i in wide}, {c: found[c] for c in distinct})

    def kpis(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """K1 of a date range, from its days."""
        return kpis(self._empty, facts=self.facts(start, end, self.classes.text[:2]))

    def statistics(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """A3 of a date range, from its days (unique counts of columns that are
        not ``exact`` are estimates)."""
        return column_statistics(self._empty, facts=self.facts(start, end))

    def quantiles(self, col: str, qs: Sequence[float], start: str | None = None, end: str | None = None) -> list[float | None]:
        """Approximate quantiles of a numeric column over a range (merged KLL sketches)."""
        i = self.columns.index(col)
        sketch = F.kll_merge_agg_double(f"k{i}")
        known = F.kll_sketch_get_n_double(sketch) > 0
        row = self.within(self._days(), start, end).agg(
            *[F.when(known, F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))).alias(f"q{j}") for j, q in enumerate(qs)]).first()
        return [row[f"q{j}"] for j in range(len(qs))]


def _merged(i: int, mean: Column) -> Column:
    """Squared deviations of many parts around their common mean."""
    n, m, v = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"v{i}")
    return F.sum(v + n * (m - mean) * (m - mean))


def _new_cube(spark, path, date_col, exact, schema, sketches) -> DayCube:
    path = (path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablelens-cube-{uuid.uuid4().hex}").rstrip("/")
    cube = DayCube(spark, path, date_col, list(exact), schema, sketches)
    layout = json.dumps({"date": date_col, "exact": list(exact), "schema": schema.json(), "sketches": sketches})
    rows_frame(spark, [(layout,)], "layout string").write.parquet(f"{path}/layout")
    return cube


def build_cube(df: DataFrame, path: str | None = None, date_col: str | None = None, exact: Sequence[str] | None = None,
               sketches: bool = True) -> DayCube:
    """The cube of a cleaned table, written to ``path`` (or under the checkpoint
    folder). ``exact``: columns whose distinct values are kept per day; by default
    the first two text columns, those the KPIs count. A table without a date
    column has no cube (ValueError)."""
    cc = column_classes(df)
    date_col = date_col or next(iter(cc.date), None)
    if date_col is None:
        raise ValueError("a daily cube needs a date column")
    exact = cc.text[:2] if exact is None else list(exact)
    schema = T.StructType([df.schema[c] for c in cc.columns])
    return _new_cube(df.sparkSession, path, date_col, exact, schema, sketches).append(df)


def open_cube(spark: SparkSession, path: str) -> DayCube:
    """A cube written earlier."""
    meta = json.loads(spark.read.parquet(f"{path.rstrip('/')}/layout").first()["layout"])
    return DayCube(spark, path.rstrip("/"), meta["date"], meta["exact"], T.StructType.fromJson(json.loads(meta["schema"])), meta["sketches"])
