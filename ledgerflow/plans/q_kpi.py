"""Registered queries: executive KPIs (A1-A11) and their filters/joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import kpi
from ledgerflow.plans.registry import (END, PREV_END, PREV_START, START, VENDOR, dlit,
                                       register)

RANGE = f"BETWEEN {dlit(START)} AND {dlit(END)}"
VWHERE = f"AND upper(v.vendor_name) = upper('{VENDOR}')"


def _ym(start, end) -> str:
    return (f"(year * 100 + month) BETWEEN {start.year * 100 + start.month} "
            f"AND {end.year * 100 + end.month}")


def _measures_sql(start, end, vendor_where: str = "") -> str:
    """WITH clause ``measures``: every measure is a scalar over the window's
    rows, the distinct counts count the rows of a DISTINCT."""
    window = f"posting_date >= {dlit(start)} AND posting_date <= {dlit(end)}"
    own = vendor_where.replace("v.vendor_name", "w.vendor_name")
    return f"""
WITH w_all AS (SELECT i.*, upper(i.invoice_status) AS st,
                      (SELECT d.vendor_name FROM v_vendor d WHERE d.vendor_id = i.vendor_id) AS vendor_name
               FROM v_invoice i WHERE {window}),
w AS (SELECT * FROM w_all w WHERE TRUE {own}),
measures AS (SELECT
  (SELECT CAST(COALESCE(SUM(invoice_amount_local) FILTER (st <> 'CANCELLED' AND st <> 'REJECTED'), 0) AS DOUBLE)
     FROM w) AS total_spend,
  (SELECT COUNT(*) FROM (SELECT DISTINCT purchase_order_reference AS x FROM w WHERE st = 'OPEN') WHERE x IS NOT NULL)
    AS active_pos,
  (SELECT COUNT(*) FROM (SELECT DISTINCT purchase_order_reference AS x FROM w) WHERE x IS NOT NULL) AS total_pos,
  (SELECT COUNT(*) FROM (SELECT DISTINCT invoice_number AS x FROM w WHERE st = 'OPEN') WHERE x IS NOT NULL)
    AS pending_inv,
  (SELECT COUNT(*) FROM (SELECT DISTINCT vendor_name AS x FROM w) WHERE x IS NOT NULL) AS active_vendors,
  (SELECT AVG(avg_payment_cycle_time_days) FROM v_payment_cycle WHERE {_ym(start, end)}) AS cycle_days,
  (SELECT CAST(SUM(payment_date - posting_date) AS DOUBLE) / COUNT(*) FROM w_all
     WHERE payment_date IS NOT NULL AND (st = 'PAID' OR st = 'CLEARED')) AS paid_days,
  (SELECT SUM(full_paid_invoices) FROM v_full_payment WHERE {_ym(start, end)}) AS fully,
  (SELECT SUM(total_cleared_invoices) FROM v_full_payment WHERE {_ym(start, end)}) AS settled,
  (SELECT COUNT(*) FROM v_status_history WHERE {window} AND upper(status) SIMILAR TO 'PAID|CLEARED') AS closed,
  (SELECT COUNT(*) FROM v_status_history WHERE {window} AND upper(status) SIMILAR TO 'PAID|CLEARED'
     AND upper(status_notes) = 'AUTO PROCESSED') AS closed_auto)"""


def kpi_sql(start, end, vendor_where: str = "") -> str:
    """The KPI row from its definition."""
    return _measures_sql(start, end, vendor_where) + """
SELECT total_spend, active_pos, total_pos, pending_inv, active_vendors,
       round(COALESCE(NULLIF(cycle_days, 0), paid_days, 0), 6) AS avg_processing_days,
       COALESCE(CAST(fully AS DOUBLE) / CAST(NULLIF(settled, 0) AS DOUBLE) * 100, 0.0) AS first_pass_rate,
       COALESCE(CAST(closed_auto AS DOUBLE) / CAST(NULLIF(closed, 0) AS DOUBLE) * 100, 0.0) AS auto_rate
FROM measures"""


def _six(df):
    """Averages of doubles to six places for the comparison: the two engines
    add the months' values up in different orders."""
    days = [c for c in df.columns if c.endswith("avg_processing_days")]
    return df.withColumns({c: F.round(c, 6) for c in days})


@register("kpi_summary", "A10", kpi_sql(START, END))
def q_kpi_summary(v):
    """A10 flagship: KPI row for the YTD window, all vendors."""
    return _six(kpi.kpi_summary(v, START, END))


@register("kpi_summary_vendor", "A10+F4+J2", kpi_sql(START, END, VWHERE))
def q_kpi_summary_vendor(v):
    """A10 with a vendor filter (left join becomes inner, R5)."""
    return _six(kpi.kpi_summary(v, START, END, VENDOR))


@register("kpi_summary_prior", "A10+F3", kpi_sql(PREV_START, PREV_END))
def q_kpi_summary_prior(v):
    """A10 over the prior window (F3)."""
    return _six(kpi.kpi_summary(v, PREV_START, PREV_END))


@register("kpi_total_spend", "A1+F1+J1", f"""
SELECT CAST(SUM(CASE WHEN upper(f.invoice_status) NOT IN ('CANCELLED','REJECTED')
            THEN COALESCE(f.invoice_amount_local, 0) ELSE 0 END) AS DOUBLE) AS total_spend
FROM v_invoice f LEFT JOIN v_vendor v ON f.vendor_id = v.vendor_id
WHERE f.posting_date {RANGE}""")
def q_kpi_total_spend(v):
    """A1 total spend in the window (minimum end-to-end slice)."""
    from ledgerflow.operators.filters import date_range
    # the vendor LEFT JOIN cannot change a sum over a keyed dimension, so the
    # spend is summed over the fact alone
    return date_range(v.invoice, START, END).agg(kpi.kpi_total_spend(None))


@register("kpi_distinct_counts", "A2-A5", f"""
SELECT COUNT(DISTINCT CASE WHEN upper(f.invoice_status) = 'OPEN' THEN f.purchase_order_reference END) AS active_pos,
       COUNT(DISTINCT f.purchase_order_reference) AS total_pos,
       COUNT(DISTINCT CASE WHEN upper(f.invoice_status) = 'OPEN' THEN f.invoice_number END) AS pending_inv,
       COUNT(DISTINCT v.vendor_name) AS active_vendors
FROM v_invoice f LEFT JOIN v_vendor v ON f.vendor_id = v.vendor_id
WHERE f.posting_date {RANGE}""")
def q_kpi_distinct_counts(v):
    """A2-A5 distinct counts in the window."""
    return kpi.distinct_counts(v, START, END)


@register("kpi_cycle_days", "A6+F6", f"""
SELECT round(AVG(CAST(avg_payment_cycle_time_days AS DOUBLE)), 6) AS avg_days
FROM v_payment_cycle WHERE {_ym(START, END)}""")
def q_kpi_cycle_days(v):
    """A6 mean of monthly cycle averages over the window's months."""
    return kpi.kpi_cycle_days(v.payment_cycle, START, END).select(
        F.round("avg_days", 6).alias("avg_days"))


@register("kpi_cycle_fallback", "A7", f"""
SELECT CAST(SUM(datediff('day', posting_date, payment_date)) AS DOUBLE) / COUNT(*) AS avg_days
FROM v_invoice WHERE upper(invoice_status) IN ('PAID','CLEARED') AND payment_date IS NOT NULL
  AND posting_date {RANGE}""")
def q_kpi_cycle_fallback(v):
    """A7 mean days from posting to payment of cleared invoices."""
    return kpi.kpi_cycle_fallback(v.invoice, START, END)


@register("kpi_first_pass", "A8", f"""
SELECT CAST(SUM(full_paid_invoices) AS BIGINT) AS fp_full_paid,
       CAST(SUM(total_cleared_invoices) AS BIGINT) AS fp_total_cleared,
       CASE WHEN SUM(total_cleared_invoices) > 0
            THEN CAST(SUM(full_paid_invoices) AS DOUBLE) / CAST(SUM(total_cleared_invoices) AS DOUBLE) * 100
            ELSE 0.0 END AS first_pass_rate
FROM v_full_payment WHERE {_ym(START, END)}""")
def q_kpi_first_pass(v):
    """A8 first-pass rate."""
    from ledgerflow.functions.scalars import ratio
    return kpi.kpi_first_pass(v.full_payment, START, END).withColumn(
        "first_pass_rate", ratio("fp_full_paid", "fp_total_cleared", 100.0))


@register("kpi_auto_rate", "A9", f"""
SELECT COUNT(*) AS auto_total,
       CAST(SUM(CASE WHEN upper(status_notes) = 'AUTO PROCESSED' THEN 1 ELSE 0 END) AS BIGINT) AS auto_processed,
       CASE WHEN COUNT(*) > 0 THEN CAST(SUM(CASE WHEN upper(status_notes) = 'AUTO PROCESSED' THEN 1 ELSE 0 END) AS DOUBLE)
            / CAST(COUNT(*) AS DOUBLE) * 100 ELSE 0.0 END AS auto_rate
FROM v_status_history WHERE posting_date {RANGE} AND upper(status) IN ('PAID','CLEARED')""")
def q_kpi_auto_rate(v):
    """A9 share of cleared history rows auto processed."""
    from ledgerflow.functions.scalars import ratio
    return kpi.kpi_auto_rate(v.status_history, START, END).withColumn(
        "auto_rate", ratio("auto_processed", "auto_total", 100.0))


def _compare_sql(vendor_where: str = "") -> str:
    cur = kpi_sql(START, END, vendor_where).strip()
    prev = kpi_sql(PREV_START, PREV_END, vendor_where).strip()
    cols = ("total_spend", "active_pos", "total_pos", "pending_inv", "active_vendors",
            "avg_processing_days", "first_pass_rate", "auto_rate")

    def pct(c):
        ch = f"((CAST(c.{c} AS DOUBLE) - CAST(p.{c} AS DOUBLE)) / CAST(p.{c} AS DOUBLE) * 100.0)"
        label = (f"CASE WHEN CAST(p.{c} AS DOUBLE) = 0 THEN (CASE WHEN CAST(c.{c} AS DOUBLE) = 0 THEN '-' ELSE '+100%' END) "
                 f"WHEN abs({ch}) < 0.05 THEN '0%' ELSE printf('%+.1f%%', {ch}) END")
        up = (f"CASE WHEN CAST(p.{c} AS DOUBLE) = 0 THEN CAST(c.{c} AS DOUBLE) >= 0 "
              f"WHEN abs({ch}) < 0.05 THEN TRUE ELSE {ch} >= 0 END")
        return label, up

    sel = [f"c.{c}" for c in cols] + [f"p.{c} AS prev_{c}" for c in cols]
    for name, c in (("spend", "total_spend"), ("active_pos", "active_pos"),
                    ("total_pos", "total_pos"), ("vendors", "active_vendors"),
                    ("pending", "pending_inv")):
        label, up = pct(c)
        if name == "vendors":
            label = f"CASE WHEN p.{c} > 0 THEN {label} ELSE '-' END"
        sel.append(f"{label} AS {name}_delta")
        sel.append(f"{'NOT ' if name == 'pending' else ''}({up}) AS {name}_good")
    dd = "(c.avg_processing_days - p.avg_processing_days)"
    fd = "(c.first_pass_rate - p.first_pass_rate)"
    sel += [f"printf('%.1f', abs({dd})) || 'd' AS days_delta", f"{dd} < 0 AS days_good",
            f"printf('%.1f', abs({fd})) || '%' AS first_pass_delta", f"{fd} > 0 AS first_pass_good",
            "'+' || printf('%.1f', c.auto_rate) || '%' AS auto_delta"]
    return (f"WITH cur AS ({cur}),\nprev AS ({prev})\nSELECT " + ",\n  ".join(sel)
            + "\nFROM cur c CROSS JOIN prev p")


@register("kpi_compare", "A11+F2+F3+C7", _compare_sql())
def q_kpi_compare(v):
    """A11 current vs prior window with deltas and direction flags."""
    return _six(kpi.kpi_compare(v, START, END))


@register("kpi_compare_vendor", "A11+F4+J2", _compare_sql(VWHERE))
def q_kpi_compare_vendor(v):
    """A11 for one vendor (both windows from one pass, vendor as a flag)."""
    return _six(kpi.kpi_compare(v, START, END, VENDOR))


def _preset(name):
    from ledgerflow.operators.filters import range_preset
    from ledgerflow.plans.registry import AS_OF
    return range_preset(name, AS_OF)


@register("kpi_summary_last30", "A10+F2", kpi_sql(*_preset("Last 30 Days")))
def q_kpi_summary_last30(v):
    """A10 for the 'Last 30 Days' preset."""
    return _six(kpi.kpi_summary(v, *_preset("Last 30 Days")))


@register("kpi_summary_qtd", "A10+F2", kpi_sql(*_preset("QTD")))
def q_kpi_summary_qtd(v):
    """A10 for the 'QTD' preset (120 days back, as the source defines it)."""
    return _six(kpi.kpi_summary(v, *_preset("QTD")))


@register("kpi_parts_cross", "J5+A1-A9", _measures_sql(START, END) + """
SELECT total_spend, active_pos, total_pos, pending_inv, active_vendors, round(cycle_days, 6) AS avg_days,
       CAST(fully AS BIGINT) AS fp_full_paid, CAST(settled AS BIGINT) AS fp_total_cleared, closed AS auto_total,
       closed_auto AS auto_processed FROM measures""")
def q_kpi_parts_cross(v):
    """J5 the four one-row aggregates CROSS JOINed, as the source merges them
    (each side is a global aggregate: one row, joined by nested loop)."""
    from ledgerflow.operators.joins import cross_scalars
    fact = kpi.fact_kpis(v.invoice, v.vendor, START, END).select(
        "total_spend", "active_pos", "total_pos", "pending_inv", "active_vendors")
    cyc = kpi.kpi_cycle_days(v.payment_cycle, START, END).select(F.round("avg_days", 6).alias("avg_days"))
    return cross_scalars(fact, cyc, kpi.kpi_first_pass(v.full_payment, START, END),
                         kpi.kpi_auto_rate(v.status_history, START, END))
