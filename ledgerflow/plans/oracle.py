"""DuckDB twins of the fixture views, inlined as a CTE prefix.

The correctness check registers only the raw tables, so every oracle
statement carries the views it reads as common table expressions. The
Spark-side builders are in ``ledgerflow.sources.fixtures``; both must
describe the same rows.
"""

from __future__ import annotations

import re

AS_OF_SQL = "DATE '2000-06-30'"
AS_OF_TS_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

# Ordered so that every view only reads views defined before it.
VIEW_SQL: dict[str, str] = {
    "v_vendor": """
SELECT CAST(s.s_suppkey AS VARCHAR) AS vendor_id, s.s_name AS vendor_name,
       'Alias ' || s.s_name AS vendor_name_2, upper(n.n_name) AS country_code,
       n.n_name AS city, CAST(10000 + s.s_suppkey AS VARCHAR) AS postal_code,
       'Street ' || CAST(s.s_suppkey AS VARCHAR) AS street
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "v_company": """
SELECT r_regionkey AS company_code, r_name AS company_name, 'HQ ' || r_name AS street,
       r_name AS city, CAST(90000 + r_regionkey AS VARCHAR) AS postal_code
FROM region""",
    "v_plant": """
SELECT n_nationkey AS plant_code, 'Plant ' || n_name AS plant_name FROM nation""",
    "v_invoice": """
SELECT b.invoice_number, b.vendor_id, b.posting_date, b.due_date,
       CASE WHEN b.st = 'PAID' THEN b.pay_date END AS payment_date,
       b.invoice_amount_local, b.purchase_order_reference, b.po_amount,
       b.plant_code, b.company_code, 'USD' AS currency,
       CAST(datediff('day', b.due_date, DATE '2000-06-30') AS INTEGER) AS aging_days,
       CASE WHEN b.ln % 2 = 0 THEN lower(b.st) ELSE b.st END AS invoice_status
FROM (
  SELECT a.*, CASE WHEN a.k = 0 THEN 'CANCELLED' WHEN a.k = 1 THEN 'REJECTED' WHEN a.k = 2 THEN 'DISPUTED'
                   WHEN a.k = 3 AND a.ln = 7 THEN NULL
                   WHEN a.pay_date <= DATE '2000-06-30' AND a.rf <> 'N' THEN 'PAID'
                   WHEN a.due_date < DATE '2000-06-30' THEN 'OVERDUE' ELSE 'OPEN' END AS st
  FROM (
    SELECT l.l_orderkey * 10 + l.l_linenumber AS invoice_number,
           CASE WHEN l.l_orderkey % 53 = 0 THEN NULL
                WHEN l.l_orderkey % 41 = 0 THEN 'X' || CAST(l.l_suppkey AS VARCHAR)
                ELSE CAST(l.l_suppkey AS VARCHAR) END AS vendor_id,
           CAST(o.o_orderdate AS DATE) AS posting_date,
           CAST(o.o_orderdate AS DATE) + CAST(20 + l.l_partkey % 70 AS INTEGER) AS pay_date,
           CASE WHEN l.l_orderkey % 97 = 0 THEN NULL
                ELSE CAST(o.o_orderdate AS DATE) + CAST(30 + (l.l_orderkey % 4) * 15 AS INTEGER) END AS due_date,
           CAST(l.l_extendedprice AS DECIMAL(12,2)) AS invoice_amount_local,
           CASE WHEN l.l_orderkey % 10 = 9 THEN NULL ELSE l.l_orderkey END AS purchase_order_reference,
           CAST(o.o_totalprice AS DECIMAL(12,2)) AS po_amount,
           s.s_nationkey AS plant_code, n.n_regionkey AS company_code,
           l.l_linenumber AS ln, l.l_returnflag AS rf, (l.l_orderkey + l.l_linenumber) % 20 AS k
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey
  ) a
) b""",
    "v_status_history": """
SELECT invoice_number, 1 AS sequence_nbr, 'Open' AS status, posting_date AS effective_date,
       'Invoice received' AS status_notes, posting_date
FROM v_invoice WHERE invoice_number % 13 <> 5
UNION ALL
SELECT invoice_number, 2, 'OVERDUE', due_date, 'Past due', posting_date
FROM v_invoice WHERE due_date < COALESCE(payment_date, DATE '2000-06-30') AND invoice_number % 13 <> 5
UNION ALL
SELECT invoice_number, 3, 'PAID', payment_date,
       CASE WHEN invoice_number % 3 = 0 THEN 'Auto Processed' ELSE 'Manual' END, posting_date
FROM v_invoice WHERE payment_date IS NOT NULL AND invoice_number % 13 <> 5""",
    "v_payment_cycle": """
SELECT CAST(year(payment_date) AS INTEGER) AS year, CAST(month(payment_date) AS INTEGER) AS month,
       CAST(SUM(datediff('day', posting_date, payment_date)) AS DOUBLE) / COUNT(*) AS avg_payment_cycle_time_days,
       COUNT(*) AS cleared_invoices
FROM v_invoice WHERE payment_date IS NOT NULL GROUP BY 1, 2""",
    "v_full_payment": """
SELECT year, month, full_paid_invoices, total_cleared_invoices,
       CAST(full_paid_invoices AS DOUBLE) / total_cleared_invoices AS full_payment_rate_pct
FROM (SELECT CAST(year(payment_date) AS INTEGER) AS year, CAST(month(payment_date) AS INTEGER) AS month,
             CAST(SUM(CASE WHEN payment_date <= due_date THEN 1 ELSE 0 END) AS BIGINT) AS full_paid_invoices,
             COUNT(*) AS total_cleared_invoices
      FROM v_invoice WHERE payment_date IS NOT NULL GROUP BY 1, 2) t""",
    "v_grir_balance": """
SELECT CAST(year(posting_date) AS INTEGER) AS year, CAST(month(posting_date) AS INTEGER) AS month,
       COUNT(*) AS invoice_count, SUM(invoice_amount_local) AS total_grir_blnc
FROM v_invoice
WHERE upper(invoice_status) IN ('OPEN','OVERDUE') AND purchase_order_reference IS NOT NULL
GROUP BY 1, 2""",
    "v_grir_aging": """
SELECT CAST(year(posting_date) AS INTEGER) AS year, CAST(month(posting_date) AS INTEGER) AS month,
       CAST(SUM(CASE WHEN datediff('day', posting_date, DATE '2000-06-30') > 60
                     THEN invoice_amount_local ELSE 0 END) AS DOUBLE)
         / CAST(SUM(invoice_amount_local) AS DOUBLE) AS pct_grir_over_60,
       CAST(SUM(CASE WHEN datediff('day', posting_date, DATE '2000-06-30') > 60 THEN 1 ELSE 0 END) AS BIGINT)
         AS cnt_grir_over_60
FROM v_invoice
WHERE upper(invoice_status) IN ('OPEN','OVERDUE') AND purchase_order_reference IS NOT NULL
GROUP BY 1, 2""",
    "v_question_history": """
SELECT e.event_id AS id, lower(trim(q.query_text)) AS normalized_query, q.query_text,
       CAST(e.user_id % 5 AS VARCHAR) AS user_name, e.ts AS asked_at
FROM events e
JOIN (SELECT e2.event_id, CASE e2.event_type
               WHEN 'signup' THEN 'Hello there'
               WHEN 'error' THEN 'Show late payment trend for ' || n.n_name
               WHEN 'click' THEN ' Total spend YTD for vendor ' || n.n_name
               WHEN 'view' THEN 'Invoice aging last 30 days for ' || n.n_name
               ELSE 'Which invoices should we pay early in ' || n.n_name || ' this quarter' END AS query_text
      FROM events e2 JOIN nation n ON n.n_nationkey = e2.user_id % 25) q
  ON q.event_id = e.event_id""",
    "v_chat_messages": """
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS turn_index, role, text AS content FROM conversations""",
    "v_chat_events": """
SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(user_id % 5 AS VARCHAR) AS user_name, event_id AS turn_index,
       CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
       event_type || ' ' || props AS content, ts
FROM events""",
    "v_chat_sessions": """
SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(user_id % 5 AS VARCHAR) AS user_name,
       MIN(ts) AS created_at, MAX(ts) AS last_updated
FROM events GROUP BY user_id""",
    "v_query_cache": """
SELECT md5(lower(trim(event_type || '-' || CAST(user_id % 7 AS VARCHAR)))) AS query_hash,
       event_type || '-' || CAST(user_id % 7 AS VARCHAR) AS question,
       MAX(ts) AS created_at, COUNT(*) - 1 AS hit_count,
       CAST(MAX(3600 * (1 + (user_id % 7) * 4)) AS BIGINT) AS ttl_seconds, event_type AS cache_type
FROM events GROUP BY event_type, user_id % 7""",
    "v_memory_changes": """
SELECT md5(CAST(user_id % 5 AS VARCHAR) || ':' || event_type) AS memory_id, CAST(user_id % 5 AS VARCHAR) AS user_name,
       event_type AS memory_key, props AS memory_val, value AS confidence,
       CASE WHEN event_type IN ('click','view') THEN 'preference' ELSE 'entity' END AS memory_type,
       'inferred' AS source, ts AS updated_at, event_id AS seq
FROM events""",
    "v_cache_writes": """
SELECT md5(lower(trim(event_type || '-' || CAST(user_id % 7 AS VARCHAR)))) AS query_hash,
       event_type || '-' || CAST(user_id % 7 AS VARCHAR) AS question, ts AS created_at, event_id,
       CAST(3600 * (1 + (user_id % 7) * 4) AS BIGINT) AS ttl_seconds, event_type AS cache_type
FROM events""",
}

_VIEW_REF = re.compile(r"\b(v_[a-z_]+)\b")


def _needed(sql: str) -> list[str]:
    need: set[str] = set()
    stack = [m for m in _VIEW_REF.findall(sql) if m in VIEW_SQL]
    while stack:
        v = stack.pop()
        if v in need:
            continue
        need.add(v)
        stack.extend(m for m in _VIEW_REF.findall(VIEW_SQL[v]) if m in VIEW_SQL)
    return [v for v in VIEW_SQL if v in need]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it (transitively) reads."""
    views = _needed(sql)
    if not views:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in views)
    body = sql.strip()
    if re.match(r"(?is)^with\s", body):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
