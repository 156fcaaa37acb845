"""D1 domain detection; M1 dataset kind; M2 metric map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import rows_frame

from ..functions.types import column_classes
from ..functions.words import (DOMAIN_KEYWORDS, GENERAL_DOMAIN, KIND_COLUMNS, METRIC_WORDS,
                               MIN_DOMAIN_SCORE, UNKNOWN_KIND)
from .heads import head_values
from .order import default_order


def keyword_pool(df: DataFrame, order: Sequence[str] | str | None = None, k: int = 100) -> DataFrame:
    """The text the domain is read from, one lower-cased piece per row: every
    column name and the first ``k`` non-null values of every text column.
    No keyword holds a blank, so testing pieces one by one equals testing
    the blank-joined pool."""
    order = default_order(df, order)
    cc = column_classes(df)
    spark = df.sparkSession
    names = rows_frame(spark, [(c,) for c in cc.columns], "piece string")
    if not cc.text:
        return names.select(F.lower("piece").alias("piece"))
    heads = head_values(df, cc.text, order, k).select(F.col("value").alias("piece"))
    return names.unionByName(heads).select(F.lower("piece").alias("piece"))


def _keyword_table():
    return F.array(*[F.struct(F.lit(d).alias("pos"), F.lit(w).alias("word"))
                     for d, (_, words) in enumerate(DOMAIN_KEYWORDS) for w in words])


def _score_rows(df: DataFrame, order, k: int) -> list[tuple[int, str, int]]:
    pool = keyword_pool(df, order, k)
    hits = (pool.select(F.explode(F.filter(_keyword_table(), lambda kw: F.col("piece").contains(kw["word"])))
                        .alias("h"))
            .select("h.pos", "h.word").distinct()
            .groupBy("pos").agg(F.count(F.lit(1)).alias("score")))
    got = {r["pos"]: int(r["score"]) for r in hits.collect()}        # at most 9 rows
    return [(d, domain, got.get(d, 0)) for d, (domain, _) in enumerate(DOMAIN_KEYWORDS)]


def domain_scores(df: DataFrame, order: Sequence[str] | str | None = None, k: int = 100) -> DataFrame:
    """Score per domain = number of its distinct keywords found in the pool.
    (position, domain, score). Each pool piece is matched against the keyword
    table with one array filter; distinct (domain, keyword) hits are counted."""
    return rows_frame(df.sparkSession, _score_rows(df, order, k), "position long, domain string, score long")


def _best(rows: list[tuple[int, str, int]]) -> tuple[str, int]:
    pos, domain, score = max(rows, key=lambda r: (r[2], -r[0]))
    return (domain if score >= MIN_DOMAIN_SCORE else GENERAL_DOMAIN), score


def detect_domain(df: DataFrame, order: Sequence[str] | str | None = None, k: int = 100) -> DataFrame:
    """The domain with the highest score, the first listed on ties; a best
    score under 2 gives ``General Business``. One row: (business_type, score)."""
    return rows_frame(df.sparkSession, [_best(_score_rows(df, order, k))], "business_type string, score long")


def domain_of(df: DataFrame, order: Sequence[str] | str | None = None) -> str:
    return _best(_score_rows(df, order, 100))[0]


def detect_kind(columns: Sequence[str]) -> str:
    """M1: dataset kind by exact lower-cased column name; first group wins."""
    present = {c.lower() for c in columns}
    return next((kind for kind, names in KIND_COLUMNS if present.intersection(names)), UNKNOWN_KIND)


def _metric_kind(column: str) -> str | None:
    """The last kind one of whose words the name contains."""
    kinds = [kind for kind, words in METRIC_WORDS if any(w in column.lower() for w in words)]
    return kinds[-1] if kinds else None


def map_metrics(columns: Sequence[str]) -> dict[str, str]:
    """M2: column → revenue / cost / profit / quantity by contained word; a
    later group overwrites an earlier one."""
    return {c: kind for c in columns if (kind := _metric_kind(c))}
