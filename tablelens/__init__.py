"""tablelens — tabular business analysis as Spark DataFrame jobs.

Give it any table (and a column order that makes its rows a sequence) and it
cleans it, profiles every column, names the business domain, computes KPIs,
chart series, trends and insights, and keeps results in tables that can be
searched, summarised and asked simple questions in bulk.
"""

from .functions.types import column_classes, column_classes_table, data_columns
from .operators.order import GlobalOrder, forward_fill
from .operators.heads import head_values, head_tail, read_first, read_heads
from .operators.order_index import OrderIndex, build_order_index, open_order_index
from .operators.text_index import TextIndex, build_text_index
from .operators.scan import forward_fill_scan, index_scan, row_sample_scan
from .operators.clean import (clean_table, coerce_numeric, fill_missing, drop_duplicate_rows, drop_duplicate_rows_by_hash,
                              anomaly_report, flag_anomalies, numeric_decisions)
from .operators.profile import (column_statistics, n_unique, top_value, null_percent, describe_all,
                                exact_quantiles, value_counts)
from .operators.quantiles import quantiles_by_narrowing
from .operators.kpi import kpis, numeric_summary
from .operators.cube import DayCube, build_cube, open_cube
from .operators.charts import (time_series_sample, row_sample, category_breakdown, histogram, charts,
                               chart_index, charts_data, value_format)
from .operators.insights import half_trend, insights, summary_text, recommendations
from .operators.domain import detect_domain, domain_of, domain_scores, detect_kind, map_metrics
from .operators.derive import derive_metrics
from .operators.explore import filter_date_range, search_rows, page, preview, clean_question, match_uploads
from .operators.catalog import (latest_analyses, recent, dashboard, dashboard_counts, explode_insights,
                                explode_recommendations, correction_lines, reuse_answers, keys_to_compute,
                                answer_questions, resolve_analyses, chat_context, source_label,
                                question_key, prompt_key, analysis_key, spread_left_join)
from .operators.context import prompt_context, prompt_text, parse_responses, parse_analyses
from .sources.files import load_table, read_csv_table, file_manifest, with_file_order
from .sources.extract import text_to_rows, cells_to_table, cells_to_records, rows_in_order
from .sources.sinks import write_analysis, read_analyses, current_analyses, write_report, mark_analyzed, ANALYSIS_SCHEMA
from .plans.analyze import analyze, analyze_range, run_analysis, Analysis

__all__ = [n for n in dir() if not n.startswith("_")]
