"""Registered queries: dashboard charts, needs-attention, vendor list,
chart pack, forecast, shares and reshapes (A12-A14, A40-A43, U1-U3, W1,
W7, P1, F15-F18)."""

from __future__ import annotations

from ledgerflow.operators import dashboard as D
from ledgerflow.operators import filters as FL
from ledgerflow.operators.reshape import unpivot_trend
from ledgerflow.plans.registry import AS_OF, END, START, VENDOR, dlit, register

RANGE = f"BETWEEN {dlit(START)} AND {dlit(END)}"
SIX_MONTHS = f"CAST({dlit(END)} - INTERVAL 6 MONTH AS DATE)"

STATUS_CASE = """CASE
  WHEN upper(invoice_status) IN ('PAID','CLEARED','CLOSED','POSTED','SETTLED') THEN 'Paid'
  WHEN upper(invoice_status) IN ('OPEN','PENDING','ON HOLD','PARKED','IN PROGRESS') THEN 'Pending'
  WHEN upper(invoice_status) IN ('DISPUTE','DISPUTED','BLOCKED','CONTESTED') THEN 'Disputed'
  ELSE 'Other' END"""

STATUS_SQL = f"""
WITH c AS (SELECT {STATUS_CASE} AS status, COUNT(*) AS cnt FROM v_invoice
           WHERE posting_date {RANGE} GROUP BY 1)
SELECT status, cnt, CASE WHEN SUM(cnt) OVER () > 0
       THEN round_even(CAST(cnt AS DOUBLE) / CAST(SUM(cnt) OVER () AS DOUBLE) * 100.0, 1) ELSE 0.0 END AS percentage
FROM c"""


@register("status_distribution", "A12+C28+W7", STATUS_SQL)
def q_status_distribution(v):
    """A12 status groups and shares in the window."""
    return D.status_distribution(v.invoice, START, END)


@register("status_distribution_min_share", "F17", f"SELECT * FROM ({STATUS_SQL}) WHERE percentage >= 3")
def q_status_min_share(v):
    """F17 drop label rows under a 3 % share."""
    return FL.min_share(D.status_distribution(v.invoice, START, END))


def _top_vendor_sql(vendor_where: str = "") -> str:
    return f"""
SELECT vendor_name, CAST(spend AS DOUBLE) AS spend FROM (
  SELECT COALESCE(v.vendor_name, 'Unknown') AS vendor_name, SUM(COALESCE(f.invoice_amount_local, 0)) AS spend
  FROM v_invoice f LEFT JOIN v_vendor v ON f.vendor_id = v.vendor_id
  WHERE f.posting_date {RANGE} {vendor_where}
  GROUP BY 1 ORDER BY spend DESC, vendor_name ASC LIMIT 10)"""


@register("top_vendors_spend", "A13+T4", _top_vendor_sql())
def q_top_vendors(v):
    """A13 top 10 vendors by spend in the window."""
    return D.top_vendors_spend(v.invoice, v.vendor, START, END)


@register("top_vendors_spend_vendor", "A13+F4+J2",
          _top_vendor_sql(f"AND upper(v.vendor_name) = upper('{VENDOR}')"))
def q_top_vendors_vendor(v):
    """A13 with the vendor filter."""
    return D.top_vendors_spend(v.invoice, v.vendor, START, END, VENDOR)


TREND_SQL = f"""
SELECT CAST(date_trunc('month', posting_date) AS DATE) AS month,
       CAST(SUM(COALESCE(invoice_amount_local, 0)) AS DOUBLE) AS actual_spend
FROM v_invoice
WHERE posting_date >= {SIX_MONTHS} AND upper(invoice_status) NOT IN ('CANCELLED','REJECTED')
GROUP BY 1"""


@register("spend_trend", "A14+F8+C1", TREND_SQL)
def q_spend_trend(v):
    """A14 monthly spend for the last 6 months."""
    return D.spend_trend(v.invoice, END)


FORECAST_SQL = f"""
WITH t AS ({TREND_SQL})
SELECT strftime(month, '%Y-%m') AS month, actual_spend,
       CASE WHEN lead(actual_spend) OVER (ORDER BY month) IS NULL THEN actual_spend * 1.1
            ELSE (actual_spend + lead(actual_spend) OVER (ORDER BY month)) / 2.0 END AS forecast_spend
FROM t"""


@register("spend_forecast", "W1", FORECAST_SQL)
def q_spend_forecast(v):
    """W1 two-month rolling forecast with the last month x 1.1."""
    return D.spend_forecast(D.spend_trend(v.invoice, END))


@register("spend_trend_long", "P1", f"""
WITH w AS ({FORECAST_SQL})
SELECT month, 'ACTUAL' AS type, actual_spend AS spend FROM w
UNION ALL SELECT month, 'FORECAST' AS type, forecast_spend AS spend FROM w""")
def q_spend_trend_long(v):
    """P1 actual/forecast columns unpivoted for the chart."""
    return unpivot_trend(D.spend_forecast(D.spend_trend(v.invoice, END)))


@register("vendor_list", "A40+U5+T1", f"""
SELECT 'All Vendors' AS vendor_name, 0 AS sort_key
UNION ALL
SELECT DISTINCT v.vendor_name, 1 AS sort_key
FROM v_invoice f LEFT JOIN v_vendor v ON f.vendor_id = v.vendor_id
WHERE f.posting_date {RANGE} AND v.vendor_name IS NOT NULL""")
def q_vendor_list(v):
    """A40 vendor choices for the window."""
    return D.vendor_list(v.invoice, v.vendor, START, END)


def _attention_sql(vendor_where: str = "") -> str:
    a = dlit(AS_OF)
    return f"""
WITH seen AS (SELECT f.*, v.vendor_name, upper(f.invoice_status) AS st, f.due_date - {a} AS ahead
              FROM v_invoice f LEFT JOIN v_vendor v USING (vendor_id) WHERE f.posting_date {RANGE} {vendor_where})
SELECT invoice_number AS ref_no, CAST(invoice_amount_local AS DOUBLE) AS amount, vendor_name, due_date, aging_days,
       CASE WHEN st = 'OVERDUE' THEN 'OVERDUE' WHEN st = 'OPEN' THEN 'DUE' ELSE 'DISPUTED' END AS category
FROM seen WHERE st = 'OVERDUE' AND ahead < 0 OR st SIMILAR TO 'DISPUTED?' OR st = 'OPEN' AND ahead BETWEEN 0 AND 30"""


@register("needs_attention", "A41+F7", _attention_sql())
def q_needs_attention(v):
    """A41 overdue / disputed / due-soon invoices, single scan."""
    return D.needs_attention(v.invoice, v.vendor, START, END, AS_OF)


@register("needs_attention_vendor", "A41+F4", _attention_sql(
    f"AND upper(v.vendor_name) = upper('{VENDOR}')"))
def q_needs_attention_vendor(v):
    """A41 with the vendor filter."""
    return D.needs_attention(v.invoice, v.vendor, START, END, AS_OF, VENDOR)


@register("needs_attention_union", "U1+F15", _attention_sql())
def q_needs_attention_union(v):
    """U1 the same rows as A41 from three tagged UNION ALL branches."""
    return D.needs_attention_union(v.invoice, v.vendor, START, END, AS_OF)


@register("needs_attention_counts", "A42", f"""
WITH a AS ({_attention_sql()})
SELECT CAST(SUM(CASE WHEN category = 'OVERDUE' THEN 1 ELSE 0 END) AS BIGINT) AS overdue_count,
       CAST(SUM(CASE WHEN category = 'DISPUTED' THEN 1 ELSE 0 END) AS BIGINT) AS disputed_count,
       CAST(SUM(CASE WHEN category = 'DUE' THEN 1 ELSE 0 END) AS BIGINT) AS due_count,
       COUNT(*) AS urgent_total
FROM a""")
def q_needs_attention_counts(v):
    """A42 counts per category and total."""
    return D.needs_attention_counts(D.needs_attention(v.invoice, v.vendor, START, END, AS_OF))


@register("needs_attention_overdue", "F16", f"""
SELECT ref_no, amount, vendor_name, due_date, aging_days
FROM ({_attention_sql()}) WHERE category = 'OVERDUE'""")
def q_needs_attention_overdue(v):
    """F16 split of the tagged result: the OVERDUE frame with the tag dropped."""
    parts = FL.split_by_tag(D.needs_attention(v.invoice, v.vendor, START, END, AS_OF),
                            "category", ["OVERDUE", "DISPUTED", "DUE"])
    return parts["OVERDUE"]


@register("chart_pack", "A43+U3+C13", f"""
WITH s AS (SELECT {STATUS_CASE} AS status, COUNT(*) AS cnt FROM v_invoice WHERE posting_date {RANGE} GROUP BY 1),
tv AS (SELECT COALESCE(v.vendor_name, 'Unknown') AS vendor_name, SUM(COALESCE(f.invoice_amount_local, 0)) AS spend
       FROM v_invoice f LEFT JOIN v_vendor v ON f.vendor_id = v.vendor_id
       WHERE f.posting_date {RANGE} GROUP BY 1 ORDER BY spend DESC, vendor_name ASC LIMIT 10),
tr AS (SELECT CAST(date_trunc('month', posting_date) AS DATE) AS month,
              SUM(COALESCE(invoice_amount_local, 0)) AS actual_spend
       FROM v_invoice WHERE posting_date >= {SIX_MONTHS}
         AND upper(invoice_status) NOT IN ('CANCELLED','REJECTED') GROUP BY 1),
p AS (SELECT CAST(status AS VARCHAR) AS col_a, CAST(cnt AS VARCHAR) AS col_b, CAST(NULL AS VARCHAR) AS col_c,
             'STATUS' AS _type FROM s
      UNION ALL SELECT vendor_name, CAST(spend AS VARCHAR), NULL, 'VENDOR' FROM tv
      UNION ALL SELECT CAST(month AS VARCHAR), CAST(actual_spend AS VARCHAR), NULL, 'TREND' FROM tr)
SELECT col_a, col_b, col_c, _type, COALESCE(TRY_CAST(col_b AS DOUBLE), 0.0) AS value FROM p""")
def q_chart_pack(v):
    """A43 the three chart inputs packed as one string table and unpacked."""
    return D.chart_pack(D.status_distribution(v.invoice, START, END),
                        D.spend_by_vendor_decimal(v.invoice, v.vendor, START, END),
                        D.spend_trend_decimal(v.invoice, END))


@register("first_non_empty", "F18", f"""
WITH a AS (SELECT invoice_number FROM v_invoice WHERE upper(invoice_status) = 'NO_SUCH_STATUS'),
b AS (SELECT DISTINCT invoice_number FROM v_invoice WHERE upper(invoice_status) = 'DISPUTED'
        AND posting_date {RANGE})
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a)""")
def q_first_non_empty(v):
    """F18 custom result when it has rows, else the fallback (here: fallback)."""
    a = FL.status_in(v.invoice, "NO_SUCH_STATUS").select("invoice_number")
    b = FL.date_range(FL.status_in(v.invoice, "DISPUTED"), START, END).select("invoice_number").distinct()
    return FL.first_non_empty(a, b)


@register("first_non_empty_primary", "F18", f"""
WITH a AS (SELECT DISTINCT invoice_number FROM v_invoice WHERE upper(invoice_status) = 'DISPUTED'
             AND posting_date {RANGE}),
b AS (SELECT invoice_number FROM v_invoice)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a)""")
def q_first_non_empty_primary(v):
    """F18 when the first result has rows, the fallback is not used."""
    a = FL.date_range(FL.status_in(v.invoice, "DISPUTED"), START, END).select("invoice_number").distinct()
    b = v.invoice.select("invoice_number")
    return FL.first_non_empty(a, b)


@register("tagged_status", "F15+F5", f"""
SELECT invoice_number, invoice_status, 'SPEND' AS category FROM v_invoice
WHERE posting_date {RANGE} AND upper(invoice_status) NOT IN ('CANCELLED','REJECTED')""")
def q_tagged_status(v):
    """F15 constant tag over the F5 status filter (null status excluded, R2)."""
    f = FL.status_not_in(FL.date_range(v.invoice, START, END), "CANCELLED", "REJECTED")
    return FL.tag_column(f.select("invoice_number", "invoice_status"), "category", "SPEND")


@register("vendor_list_all", "A40+U5", """
SELECT 'All Vendors' AS vendor_name, 0 AS sort_key
UNION ALL SELECT DISTINCT vendor_name, 1 AS sort_key FROM v_vendor""")
def q_vendor_list_all(v):
    """A40 all vendor names of the dimension."""
    return D.vendor_names_all(v.vendor)
