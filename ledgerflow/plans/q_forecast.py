"""Registered queries: cash flow, early payment, payment timing, late
payment trend and GR/IR (A15-A27, J7, W3, U2, T2, C29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.functions.scalars import bucket_label
from ledgerflow.operators import forecast as FC
from ledgerflow.operators.setops import union_total_row
from ledgerflow.operators.windows import latest_row
from ledgerflow.plans.registry import AS_OF, dlit, register

A = dlit(AS_OF)

BUCKETS_SQL = f"""
WITH edges(label, above, upto) AS (VALUES ('OVERDUE_NOW', NULL, -1), ('DUE_7_DAYS', -1, 7), ('DUE_14_DAYS', 7, 14),
  ('DUE_30_DAYS', 14, 30), ('DUE_60_DAYS', 30, 60), ('DUE_90_DAYS', 60, 90), ('BEYOND_90_DAYS', 90, NULL)),
unpaid AS (SELECT due_date, due_date - {A} AS ahead, invoice_amount_local AS money FROM v_invoice
           WHERE due_date IS NOT NULL AND upper(invoice_status) SIMILAR TO 'OPEN|DUE|OVERDUE')
SELECT CASE WHEN GROUPING(e.label) = 1 THEN 'TOTAL_UNPAID' ELSE e.label END AS forecast_bucket,
       CASE WHEN GROUPING(e.label) = 1 THEN NULLIF(COUNT(*), 0) ELSE COUNT(*) END AS invoice_count,
       CAST(SUM(u.money) AS DOUBLE) AS total_amount,
       CASE WHEN GROUPING(e.label) = 0 THEN MIN(u.due_date) END AS earliest_due,
       CASE WHEN GROUPING(e.label) = 0 THEN MAX(u.due_date) END AS latest_due
FROM unpaid u JOIN edges e ON (e.above IS NULL OR u.ahead > e.above) AND (e.upto IS NULL OR u.ahead <= e.upto)
GROUP BY ROLLUP (e.label)"""


def _buckets(v):
    return FC.cash_flow_buckets(v.invoice, AS_OF)


@register("cash_flow_buckets", "A15+U2+C3", BUCKETS_SQL)
def q_cash_flow_buckets(v):
    """A15 unpaid invoices by due bucket plus the TOTAL_UNPAID row."""
    return _buckets(v)


@register("cash_flow_total_union", "U2", f"""
SELECT CASE WHEN due_date < {A} THEN 'LATE' ELSE 'AHEAD' END AS side, COUNT(*) AS invoice_count,
       CAST(NULL AS DATE) AS latest_due
FROM v_invoice WHERE due_date IS NOT NULL GROUP BY 1
UNION ALL SELECT 'ALL', COUNT(due_date), NULL FROM v_invoice""")
def q_cash_flow_total_union(v):
    """U2 a TOTAL row UNION ALL the group rows, typed nulls elsewhere."""
    side = F.when(F.col("due_date") < F.lit(AS_OF), F.lit("LATE")).otherwise(F.lit("AHEAD"))
    groups = (v.invoice.filter(F.col("due_date").isNotNull()).groupBy(side.alias("side"))
              .agg(F.count(F.lit(1)).alias("invoice_count"), F.lit(None).cast("date").alias("latest_due")))
    return union_total_row(groups, "side", "ALL", ["invoice_count"], {"latest_due": "date"})


@register("cash_flow_ordered", "A16+T2", f"""
SELECT *, CASE forecast_bucket WHEN 'TOTAL_UNPAID' THEN 0 WHEN 'OVERDUE_NOW' THEN 1
  WHEN 'DUE_7_DAYS' THEN 2 WHEN 'DUE_14_DAYS' THEN 3 WHEN 'DUE_30_DAYS' THEN 4
  WHEN 'DUE_60_DAYS' THEN 5 WHEN 'DUE_90_DAYS' THEN 6 WHEN 'BEYOND_90_DAYS' THEN 7 ELSE 8 END AS bucket_order
FROM ({BUCKETS_SQL})""")
def q_cash_flow_ordered(v):
    """A16 buckets in their fixed display order."""
    return FC.cash_flow_ordered(_buckets(v))


@register("cash_flow_labels", "C29+P4", f"""
SELECT CASE upper(forecast_bucket) WHEN 'TOTAL_UNPAID' THEN 'Total Unpaid' WHEN 'OVERDUE_NOW' THEN 'Overdue Now'
  WHEN 'DUE_7_DAYS' THEN 'Due in 7 Days' WHEN 'DUE_14_DAYS' THEN 'Due in 14 Days'
  WHEN 'DUE_30_DAYS' THEN 'Due in 30 Days' WHEN 'DUE_60_DAYS' THEN 'Due in 60 Days'
  WHEN 'DUE_90_DAYS' THEN 'Due in 90 Days' WHEN 'BEYOND_90_DAYS' THEN 'Beyond 90 Days'
  ELSE forecast_bucket END AS time_bucket, invoice_count
FROM ({BUCKETS_SQL})""")
def q_cash_flow_labels(v):
    """C29 bucket codes shown with their labels."""
    return _buckets(v).select(bucket_label("forecast_bucket").alias("time_bucket"), "invoice_count")


@register("cash_flow_headline", "A17", f"""
WITH c AS ({BUCKETS_SQL}),
h AS (SELECT COALESCE(CAST(SUM(CASE WHEN forecast_bucket = 'TOTAL_UNPAID' THEN CAST(total_amount AS DECIMAL(38,2)) END) AS DOUBLE), 0.0) AS total_unpaid,
             COALESCE(CAST(SUM(CASE WHEN forecast_bucket = 'OVERDUE_NOW' THEN CAST(total_amount AS DECIMAL(38,2)) END) AS DOUBLE), 0.0) AS overdue_now,
             COALESCE(CAST(SUM(CASE WHEN forecast_bucket IN ('DUE_7_DAYS','DUE_14_DAYS','DUE_30_DAYS')
                               THEN CAST(total_amount AS DECIMAL(38,2)) END) AS DOUBLE), 0.0) AS due_30_days FROM c)
SELECT *, CASE WHEN total_unpaid > 0 THEN due_30_days / total_unpaid * 100.0 ELSE 0.0 END AS pct_due_30 FROM h""")
def q_cash_flow_headline(v):
    """A17 cash-flow headline figures."""
    return FC.cash_flow_headline(_buckets(v))


EARLY_SQL = f"""
SELECT CAST(f.invoice_number AS VARCHAR) AS document_number, v.vendor_name,
       CAST(f.invoice_amount_local AS DOUBLE) AS invoice_amount, f.due_date,
       CAST(datediff('day', {A}, f.due_date) AS INTEGER) AS days_until_due,
       CAST(round(f.invoice_amount_local * 0.02, 2) AS DOUBLE) AS savings_if_2pct_discount,
       CASE WHEN datediff('day', {A}, f.due_date) <= 7 THEN 'High'
            WHEN datediff('day', {A}, f.due_date) <= 14 THEN 'Medium' ELSE 'Low' END AS early_pay_priority
FROM v_invoice f LEFT JOIN v_vendor v ON f.vendor_id = v.vendor_id
WHERE upper(f.invoice_status) IN ('OPEN','DUE') AND f.due_date > {A} AND datediff('day', {A}, f.due_date) <= 30
ORDER BY early_pay_priority ASC, round(f.invoice_amount_local * 0.02, 2) DESC, document_number ASC,
         v.vendor_name ASC NULLS LAST, f.due_date ASC, f.invoice_amount_local ASC
LIMIT 20"""


@register("early_payment", "A18+T4+C14", EARLY_SQL)
def q_early_payment(v):
    """A18 early-payment candidates."""
    return FC.early_payment(v.invoice, v.vendor, AS_OF)


@register("early_payment_headline", "A19", f"""
SELECT CAST(COALESCE(SUM(CAST(savings_if_2pct_discount AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_savings,
       CAST(SUM(CASE WHEN early_pay_priority = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS high_priority
FROM ({EARLY_SQL})""")
def q_early_payment_headline(v):
    """A19 total saving and High count of the candidates."""
    return FC.early_payment_headline(FC.early_payment(v.invoice, v.vendor, AS_OF))


@register("payment_timing", "A20+T2", f"""
WITH db AS (SELECT CASE WHEN due_date < {A} THEN 'Overdue'
                        WHEN due_date <= {A} + INTERVAL 7 DAY THEN 'Due in 0-7 days'
                        WHEN due_date <= {A} + INTERVAL 14 DAY THEN 'Due in 8-14 days'
                        WHEN due_date <= {A} + INTERVAL 30 DAY THEN 'Due in 15-30 days'
                        ELSE 'Due later' END AS payment_window,
                   COUNT(*) AS invoice_count, CAST(SUM(invoice_amount_local) AS DOUBLE) AS total_amount
            FROM v_invoice WHERE upper(invoice_status) IN ('OPEN','DUE') GROUP BY 1)
SELECT *, CASE payment_window WHEN 'Overdue' THEN 1 WHEN 'Due in 0-7 days' THEN 2
  WHEN 'Due in 8-14 days' THEN 3 WHEN 'Due in 15-30 days' THEN 4 ELSE 5 END AS window_order FROM db""")
def q_payment_timing(v):
    """A20 open/due invoices by payment window."""
    return FC.payment_timing(v.invoice, AS_OF)


@register("late_payment_trend", "A21", f"""
SELECT CAST(date_trunc('month', payment_date) AS DATE) AS month, COUNT(*) AS total_payments,
       CAST(SUM(CASE WHEN payment_date > due_date THEN 1 ELSE 0 END) AS BIGINT) AS late_payments,
       CAST(SUM(CASE WHEN payment_date > due_date THEN datediff('day', due_date, payment_date) END) AS DOUBLE)
         / SUM(CASE WHEN payment_date > due_date THEN 1 ELSE 0 END) AS avg_late_days,
       CAST(SUM(CASE WHEN payment_date > due_date THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) * 100.0 AS late_pct
FROM v_invoice
WHERE payment_date IS NOT NULL AND payment_date >= CAST({A} - INTERVAL 12 MONTH AS DATE)
GROUP BY 1""")
def q_late_payment_trend(v):
    """A21 monthly late-payment trend."""
    return FC.late_payment_trend(v.invoice, AS_OF)


@register("grir_hotspots", "A22+C15", """
SELECT year, month, invoice_count, CAST(total_grir_blnc AS DOUBLE) AS total_grir_balance,
       CAST(row_number() OVER (ORDER BY year DESC, month DESC) AS INTEGER) AS month_rank,
       CASE WHEN row_number() OVER (ORDER BY year DESC, month DESC) <= 12
            THEN printf('%04d-%02d', year, month) END AS label
FROM v_grir_balance""")
def q_grir_hotspots(v):
    """A22 GR/IR balance by month, newest first, labelled."""
    return FC.grir_hotspots(v.grir_balance)


@register("grir_position", "A23+J7", """
WITH newest AS (SELECT * FROM v_grir_aging
                WHERE year * 12 + month = (SELECT MAX(year * 12 + month) FROM v_grir_aging))
SELECT b.year, b.month, b.invoice_count AS grir_items, CAST(b.total_grir_blnc AS DOUBLE) AS total_grir_balance,
       (SELECT pct_grir_over_60 FROM newest n WHERE n.year = b.year AND n.month = b.month) AS pct_grir_over_60,
       (SELECT cnt_grir_over_60 FROM newest n WHERE n.year = b.year AND n.month = b.month) AS cnt_grir_over_60,
       COALESCE(CAST(b.total_grir_blnc AS DOUBLE) * (SELECT pct_grir_over_60 FROM newest n
                WHERE n.year = b.year AND n.month = b.month), 0.0) AS amount_over_60_days
FROM v_grir_balance b
WHERE b.year * 12 + b.month = (SELECT MAX(year * 12 + month) FROM v_grir_balance)""")
def q_grir_position(v):
    """A23 newest GR/IR position."""
    return FC.grir_position(v.grir_balance, v.grir_aging)


@register("grir_latest_aging", "W3", """
SELECT * FROM v_grir_aging ORDER BY year DESC, month DESC LIMIT 1""")
def q_grir_latest_aging(v):
    """W3 newest (year, month) row."""
    return latest_row(v.grir_aging, "year", "month")


@register("grir_trend_24", "A24+T4", """
SELECT year, month, invoice_count, CAST(total_grir_blnc AS DOUBLE) AS total_grir_blnc
FROM v_grir_balance ORDER BY year DESC, month DESC LIMIT 24""")
def q_grir_trend(v):
    """A24 newest 24 months of GR/IR balance."""
    return FC.grir_trend(v.grir_balance)


@register("grir_root_cause_inputs", "A25", """
WITH a AS (SELECT * FROM v_grir_aging ORDER BY year DESC, month DESC LIMIT 6),
b AS (SELECT year, month, CAST(total_grir_blnc AS DOUBLE) AS total_grir_blnc FROM v_grir_balance
      ORDER BY year DESC, month DESC LIMIT 6)
SELECT COALESCE(a.year, b.year) AS year, COALESCE(a.month, b.month) AS month,
       a.pct_grir_over_60, a.cnt_grir_over_60, b.total_grir_blnc
FROM a FULL OUTER JOIN b ON a.year = b.year AND a.month = b.month""")
def q_grir_root_cause_inputs(v):
    """A25 newest 6 aging and balance rows side by side."""
    return FC.grir_root_cause_inputs(v.grir_balance, v.grir_aging)


def _wc_sql(mode: str) -> str:
    cur = AS_OF.year * 100 + AS_OF.month
    if mode == "yyyymm":
        o60, o90 = f"(year * 100 + month) <= {cur - 60}", f"(year * 100 + month) <= {cur - 90}"
    else:
        age = f"datediff('day', last_day(make_date(year, month, 1)), {A})"
        o60, o90 = f"{age} > 60", f"{age} > 90"
    return f"""
SELECT year, month, CAST(total_grir_blnc AS DOUBLE) AS total_grir_blnc,
       CASE WHEN {o60} THEN CAST(total_grir_blnc AS DOUBLE) ELSE 0.0 END AS older_than_60_days,
       CASE WHEN {o90} THEN CAST(total_grir_blnc AS DOUBLE) ELSE 0.0 END AS older_than_90_days
FROM v_grir_balance"""


@register("grir_working_capital_yyyymm", "A26", _wc_sql("yyyymm"))
def q_grir_wc_yyyymm(v):
    """A26 working capital released, reference yyyymm arithmetic."""
    return FC.grir_working_capital(v.grir_balance, AS_OF, "yyyymm")


@register("grir_working_capital_days", "A26", _wc_sql("days"))
def q_grir_wc_days(v):
    """A26 working capital released, ages in days."""
    return FC.grir_working_capital(v.grir_balance, AS_OF, "days")


@register("grir_working_capital_totals", "A26", f"""
SELECT COALESCE(CAST(SUM(CAST(older_than_60_days AS DECIMAL(38,2))) AS DOUBLE), 0.0) AS older_60,
       COALESCE(CAST(SUM(CAST(older_than_90_days AS DECIMAL(38,2))) AS DOUBLE), 0.0) AS older_90
FROM ({_wc_sql("yyyymm")})""")
def q_grir_wc_totals(v):
    """A26 totals over months."""
    return FC.grir_working_capital_totals(FC.grir_working_capital(v.grir_balance, AS_OF, "yyyymm"))


@register("grir_vendor_followup", "A27", f"""
SELECT vendor_name, grir_count, CAST(amt AS DOUBLE) AS total_amount,
       CAST(age AS DOUBLE) / grir_count AS avg_age_days
FROM (SELECT v.vendor_name, COUNT(*) AS grir_count, SUM(f.invoice_amount_local) AS amt,
             SUM(datediff('day', f.posting_date, {A})) AS age
      FROM v_invoice f LEFT JOIN v_vendor v ON f.vendor_id = v.vendor_id
      WHERE upper(f.invoice_status) = 'OPEN' AND f.purchase_order_reference IS NOT NULL
      GROUP BY v.vendor_name ORDER BY amt DESC NULLS LAST, v.vendor_name ASC NULLS LAST LIMIT 10)""")
def q_grir_vendor_followup(v):
    """A27 vendors to follow up on open GR/IR items."""
    return FC.grir_vendor_followup(v.invoice, v.vendor, AS_OF)
