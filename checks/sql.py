"""The fixtures of ``fixtures.py`` and shared pieces, as DuckDB SQL."""

from __future__ import annotations

LINEITEM_ORDER_SQL = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
                      "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")
MESSY_ORDER_SQL = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, o_q, l_extendedprice, o_d, l_tax, o_r, "
                   "l_linestatus, l_shipdate")

LINEITEM_MESSY = """
lm AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         l_extendedprice,
         CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount,
         l_tax,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate,
         l_quantity AS o_q, l_discount AS o_d, l_returnflag AS o_r
  FROM lineitem)"""

ORDERS_MESSY = """
om_base AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders),
om AS (
  SELECT *, 0 AS copy_no FROM om_base
  UNION ALL
  SELECT *, 1 AS copy_no FROM om_base WHERE o_orderkey % 10 = 0)"""

PART_MESSY = """
pm AS (
  SELECT p_partkey,
         CASE WHEN p_partkey % 4 = 0 THEN 'n/a' ELSE '$' || format('{:,.2f}', p_retailprice) END AS price_text,
         CASE WHEN p_partkey % 10 < 3 THEN 'n/a' ELSE '$' || format('{:,.2f}', p_retailprice) END AS price_text_70,
         CAST(p_size AS VARCHAR) || '%' AS size_pct,
         p_name
  FROM part)"""

EVENTS_OUTLIERS = """
eo AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_id % 1000 = 0 THEN value * 1000 ELSE value END AS value, props
  FROM events)"""

ANALYSES = """
an AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
         CAST(user_id AS VARCHAR) AS upload_id,
         CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'processing' END AS status,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS business_type,
         CASE WHEN event_id % 7 = 0 THEN '' ELSE 'Events of type ' || event_type END AS summary,
         [ {'title': event_type || ' insight', 'description': props,
            'severity': CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'warning' END, 'category': 'Trend'},
           {'title': CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Second look' END, 'description': CAST(NULL AS VARCHAR),
            'severity': '', 'category': CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'Data' END} ] AS insights,
         CASE WHEN event_id % 6 = 5 THEN NULL ELSE
           [ {'title': 'Check ' || event_type, 'description': props,
              'priority': CASE WHEN event_id % 2 = 0 THEN 'high' ELSE '' END, 'impact': ''} ] END AS recommendations,
         event_id % 6 = 5 AS no_recs,
         CASE WHEN event_id % 8 = 7 THEN NULL ELSE
           [ {'name': 'value', 'value': CAST(value AS DOUBLE), 'type': 'number', 'icon': 'sum'},
             {'name': 'user', 'value': CAST(user_id AS DOUBLE), 'type': 'count', 'icon': 'hash'} ] END AS kpis,
         ts AS created_at
  FROM events)"""

UPLOADS = """
up AS (
  SELECT CAST(user_id AS VARCHAR) AS id,
         CASE WHEN user_id % 9 = 0 THEN '' ELSE 'file_' || CAST(user_id AS VARCHAR) || '.csv' END AS original_name,
         min(ts) AS created_at
  FROM events WHERE user_id % 13 <> 0 GROUP BY user_id)"""

QUESTIONS = """
qs AS (
  SELECT conv_id * 1000 + turn AS question_id,
         (['summary: ', 'show kpi: ', 'any insight? ', 'what should we do? ', ''])[conv_id % 5 + 1] || text AS question,
         CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) END AS analysis_id,
         CASE WHEN conv_id % 3 <> 1 THEN CAST(conv_id % 150 AS VARCHAR) END AS upload_id
  FROM conversations WHERE role = 'user')"""


def chat_key(scope: str, question: str) -> str:
    norm = f"lower(regexp_replace({question}, '^\\s+|\\s+$', '', 'g'))"
    return f"('chat:' || {scope} || ':' || substr(sha256({norm}), 1, 16))"


CHAT = f"""
rq AS (
  SELECT conv_id * 1000 + turn AS request_id, CAST(conv_id % 150 AS VARCHAR) AS analysis_id, text AS question
  FROM conversations WHERE role = 'user'),
hist AS (
  SELECT {chat_key("CAST(conv_id % 150 AS VARCHAR)", "' ' || text || chr(9) || ' '")} AS key,
         'answer ' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS answer,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(turn AS INTEGER)) AS created_at
  FROM conversations WHERE role = 'user' AND (conv_id + turn) % 3 = 0),
fresh AS (
  SELECT key, arg_max(answer, created_at) AS cached_answer FROM hist
  WHERE created_at <= TIMESTAMP '2024-01-01 05:00:00'
    AND created_at > TIMESTAMP '2024-01-01 05:00:00' - INTERVAL 14400 SECOND
  GROUP BY key)"""

DOCS = """
dc AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc, CASE WHEN doc_id % 97 = 0 THEN '' ELSE text END AS text FROM documents)"""


def py_round(expr: str, d: int) -> str:
    """Python round(x, d) for a double: printf rounds the exact binary value."""
    return f"CAST(printf('%.{d}f', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def py_repr(expr: str) -> str:
    return f"CAST(CAST({expr} AS DOUBLE) AS VARCHAR)"


def js_number(expr: str) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e16 THEN CAST(CAST({x} AS DECIMAL(38,0)) AS VARCHAR) "
            f"ELSE CAST({x} AS VARCHAR) END)")


def py_datetime(expr: str) -> str:
    return (f"(CASE WHEN {expr} IS NULL THEN 'None' WHEN microsecond({expr}) % 1000000 = 0 "
            f"THEN strftime({expr}, '%Y-%m-%d %H:%M:%S') ELSE strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') END)")


def value_text(value: str, kind: str) -> str:
    """Python str() of a KPI value: ints for counts, floats otherwise."""
    return f"(CASE WHEN {kind} = 'count' THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) ELSE {py_repr(value)} END)"


def id_groups(expr: str) -> str:
    return f"replace(format('{{:,.0f}}', abs(round(CAST({expr} AS DOUBLE)))), ',', '.')"


def rupiah(expr: str) -> str:
    r = f"round(CAST({expr} AS DOUBLE))"
    return f"(CASE WHEN {r} < 0 THEN '-' ELSE '' END || 'Rp' || chr(160) || {id_groups(expr)})"


def number_id(expr: str) -> str:
    r = f"round(CAST({expr} AS DOUBLE))"
    return f"(CASE WHEN {r} < 0 THEN '-' ELSE '' END || {id_groups(expr)})"


def contains_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"
