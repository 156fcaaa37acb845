"""B1 full analysis of one table; B2 re-analysis for a date range.

Passes of ``analyze`` (each a Spark job over the whole table, or over the
cleaned copy written once to the checkpoint folder):

0. first 50 values of every text column (one top-k per column) → number-conversion decisions
1. null counts and row count in one aggregate; range-bucket boundaries from a bounded sample
2. per-bucket last values (only when numeric nulls exist)
3. fill + de-duplication, written once (checkpoint)
4. ``TableFacts``: every per-column measure in one aggregate plus one aggregate of distinct
   counts — KPIs, statistics, anomaly bounds, insights, numeric summary and histogram bounds
   all read it
5. one aggregate counting anomalies and the histogram bins of the first numeric column;
   domain pool (first 100 text values), top values, category breakdown
6. trend boundary (one bucket sorted) and half means
7. chart series (only the buckets holding sampled positions are sorted)
"""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import rows_frame

from ..functions.types import column_classes
from ..operators.charts import (HISTOGRAM_SCHEMA, Chart, chart_index, charts, histogram_bin, histogram_layout,
                                histogram_rows)
from ..operators.clean import Cleaned, clean_table
from ..operators.cube import DayCube
from ..operators.domain import domain_of
from ..operators.explore import filter_date_range, preview
from ..operators.insights import half_trend, insights, recommendations, summary_text
from ..operators.kpi import kpis
from ..operators.order import GlobalOrder, default_order
from ..operators.profile import column_statistics, table_facts
from ..sources.sinks import ANALYSIS_SCHEMA

logger = logging.getLogger(__name__)


@dataclass
class Analysis:
    table: DataFrame
    order: list[str]
    cleaned: Cleaned
    business_type: str
    kpis: DataFrame
    trends: DataFrame
    insights: DataFrame
    recommendations: DataFrame
    summary: str
    charts: list[Chart]
    preview: DataFrame
    column_stats: DataFrame
    extra: dict = field(default_factory=dict)

    def release(self) -> bool:
        """Delete the written copy of the cleaned table once the results are stored."""
        return self.cleaned.release()

    def chart_index(self) -> DataFrame:
        return chart_index(self.table.sparkSession, self.charts)

    def chart_items(self) -> list[tuple]:
        """The charts as they are stored: their parts and points (a chart has
        less than a hundred points by construction) as JSON rows."""
        out = []
        index = {r["chart_no"]: r["value_format"] for r in self.chart_index().collect()} if self.charts else {}
        for i, c in enumerate(self.charts):
            place = next((k for k in ("idx", "position", "bin", "rank", "index") if k in c.data.columns), None)
            data = c.data.orderBy(place) if place else c.data
            keys = [c.name_key or c.x_key, *c.data_keys]
            points = [json.dumps({k: r[k] for k in keys}, default=str, ensure_ascii=False) for r in data.collect()]
            out.append((c.type, c.title, c.x_key, list(c.data_keys), c.name_key, index.get(i), points))
        return out

    def record(self, analysis_id: str, upload_id: str, created_at: datetime | None = None) -> DataFrame:
        """The analysis as one ``analyses`` row (status ``completed``)."""
        spark = self.table.sparkSession
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        created = created_at or now
        ins = [tuple(r[k] for k in ["title", "description", "severity", "category"])
               for r in self.insights.orderBy("position").collect()]
        recs = [tuple(r[k] for k in ["title", "description", "priority", "impact"])
                for r in self.recommendations.orderBy("position").collect()]
        kp = [(r["name"], r["value"], r["type"], r["icon"], None) for r in self.kpis.orderBy("kpi_order").collect()]
        tr = [(r["column"], r["direction"], r["change_percent"], r["description"])
              for r in self.trends.orderBy("position").collect()]
        corr = [(r["column"], r["action"], r["affected_rows"]) for r in self.cleaned.report.collect()]
        stats = {r["column"]: {k: r[k] for k in ["dtype", "null_count", "unique_count", "mean", "min", "max", "std"]
                               if r[k] is not None}
                 for r in self.column_stats.orderBy("position").collect()}
        cols = column_classes(self.table).columns
        prev = [json.dumps({c: r[c] for c in cols}, default=str, ensure_ascii=False)
                for r in self.preview.collect()]
        row = (analysis_id, upload_id, "completed", self.business_type, self.summary, ins, recs, kp, tr, corr,
               json.dumps(stats, indent=2, default=str), prev, self.chart_items(), created, now)
        return rows_frame(spark, [row], ANALYSIS_SCHEMA)


def analyze(df: DataFrame, order: Sequence[str] | str | None = None, persist: bool = True,
            approx: bool = False) -> Analysis:
    """B1: clean, name the domain, KPIs, trends, insights, summary,
    recommendations, charts, preview and column statistics of one table.
    ``approx=True`` uses approximate distinct counts (unique KPIs, statistics)
    for very large or wide tables; everything else stays exact."""
    order = default_order(df, order)
    layout: dict = {}

    def histogram_counts(t, facts):
        # pass 5: the histogram of the first numeric column is counted in the anomaly scan
        num = column_classes(t).numeric
        if not num:
            return {}
        c = num[0]
        spec = histogram_layout(facts.count[c], facts.min[c], facts.max[c])
        if spec is None:
            layout["rows"] = []
            return {}
        bins, width = spec
        lo = float(facts.min[c])
        layout.update(lo=lo, width=width, bins=bins)
        b = histogram_bin(c, lo, width, bins)
        return {f"bin{i}": F.col(c).isNotNull() & (b == i) for i in range(bins)}

    cleaned = clean_table(df, order, persist=persist, extra_counts=histogram_counts, approx=approx, distinct=True)
    t = cleaned.table
    n = cleaned.rows_after
    cc = column_classes(t)
    spark = t.sparkSession
    hist = None
    if "rows" in layout:
        hist = rows_frame(spark, layout["rows"], HISTOGRAM_SCHEMA)
    elif "bins" in layout:
        counts = [cleaned.counts[f"bin{i}"] for i in range(layout["bins"])]
        hist = rows_frame(spark, histogram_rows(layout["lo"], layout["width"], counts), HISTOGRAM_SCHEMA)
    domain = domain_of(t, order)
    facts = cleaned.facts
    kpi_df = kpis(t, facts=facts)
    kpi_rows = [(r["name"], r["value"], r["type"]) for r in kpi_df.orderBy("kpi_order").collect()]
    go = None
    if cc.numeric:
        go = cleaned.buckets.on(t, n) if cleaned.buckets is not None else GlobalOrder.build(t, order, n_rows=n)
    trends = half_trend(t, cc.numeric[:3], order, go=go)
    ins = insights(t, domain, order, trends=trends, facts=facts)
    summary = summary_text(domain, n, cc.columns, cc.numeric, cc.text, kpi_rows)
    recs = recommendations(spark, domain)
    chart_list = charts(t, order, n_rows=n, facts=facts, histogram_data=hist)
    pv = preview(t, order, 50)
    stats = column_statistics(t, facts=facts)
    return Analysis(t, order, cleaned, domain, kpi_df, trends, ins, recs, summary, chart_list, pv, stats)


def analyze_range(df: DataFrame, stored: dict, start: str | None, end: str | None,
                  order: Sequence[str] | str | None = None, persist: bool = True,
                  clean: Cleaned | None = None, cube: DayCube | None = None) -> dict:
    """B2: filter the first date column of the cleaned table to [start, end],
    then new charts, KPIs and preview; everything else comes from ``stored``.
    No bounds or no date column → ``stored`` unchanged, without a job.

    ``clean``: the kept cleaned table (``Analysis.cleaned``, or a stored copy as
    ``Cleaned.of(table, order)``), so the range filter is pushed into its scan
    and nothing is cleaned again. Without it the table is cleaned here, and
    ``out["cleaned"].release()`` drops the copy that was written for it.

    ``cube``: the daily cube of the cleaned table (``build_cube``): KPIs and the
    bounds that the charts need come from the days of the range, not its rows."""
    order = default_order(df, order)
    # cleaning never changes which columns hold dates: the schema tells before any job
    if (not start and not end) or not column_classes(df).date:
        return stored
    cleaned = clean if clean is not None else clean_table(df, order, persist=persist, report=False)
    t = cleaned.table
    cc = column_classes(t)
    sub = filter_date_range(t, start, end, cc.date[0])
    facts = cube.facts(start, end, cc.text[:2]) if cube is not None else table_facts(sub, distinct=cc.text[:2])
    out = dict(stored)
    out["charts"] = charts(sub, order, n_rows=facts.rows, facts=facts)
    out["kpis"] = kpis(sub, facts=facts)
    out["raw_data_preview"] = preview(sub, order, 50)
    out["table"] = sub
    if clean is None:
        out["cleaned"] = cleaned
    return out



def _bare_record(spark, analysis_id: str, upload_id: str, status: str, summary: str | None,
                 created: datetime, completed: datetime | None) -> DataFrame:
    row = (analysis_id, upload_id, status, None, summary, None, None, None, None, None, None, None, None, created,
           completed)
    return rows_frame(spark, [row], ANALYSIS_SCHEMA)


def run_analysis(df: DataFrame, analysis_id: str, upload_id: str, path: str | None = None,
                 order: Sequence[str] | str | None = None, approx: bool = False) -> DataFrame:
    """S7 + B1: the record life cycle — a ``processing`` record, then the
    ``completed`` record, or a ``failed`` one whose summary carries the error.
    With ``path`` every state is appended to that records folder (the current
    state is the newest record, see ``current_analyses``). Returns the final record."""
    from ..sources.sinks import write_analysis

    spark = df.sparkSession
    created = datetime.now(timezone.utc).replace(tzinfo=None)
    if path:
        write_analysis(_bare_record(spark, analysis_id, upload_id, "processing", None, created, None), path)
    a = None
    try:
        a = analyze(df, order, approx=approx)
        final = a.record(analysis_id, upload_id, created_at=created)
    except Exception as e:  # noqa: BLE001 — any failure is stored, as the application does
        logger.exception("analysis %s failed", analysis_id)
        final = _bare_record(spark, analysis_id, upload_id, "failed", f"Analysis failed: {e}", created,
                             datetime.now(timezone.utc).replace(tzinfo=None))
    finally:
        if a is not None:
            a.release()
    if path:
        write_analysis(final, path)
    return final
