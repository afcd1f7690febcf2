"""Registered queries: invoice lookup, search and 360 view (F11-F13,
I1-I4, J3-J4, U7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import filters as FL
from ledgerflow.operators import invoices as I
from ledgerflow.operators.joins import vendor_profile
from ledgerflow.operators.windows import page_index
from ledgerflow.plans.registry import AS_OF, END, INVOICE, START, VENDOR, dlit, register

A = dlit(AS_OF)


@register("invoice_lookup", "F11+T5", f"""
SELECT f.invoice_number, f.posting_date AS invoice_date, CAST(f.invoice_amount_local AS DOUBLE) AS invoice_amount,
       f.purchase_order_reference AS po_number, CAST(f.po_amount AS DOUBLE) AS po_amount, f.due_date,
       upper(f.invoice_status) AS invoice_status, f.aging_days, f.vendor_id, v.vendor_name, v.vendor_name_2,
       v.country_code, v.city, v.postal_code, v.street, f.company_code, f.plant_code, f.currency
FROM v_invoice f LEFT JOIN v_vendor v ON f.vendor_id = v.vendor_id
WHERE f.invoice_number = TRY_CAST('{INVOICE}' AS BIGINT)
ORDER BY f.vendor_id, invoice_amount, invoice_date, f.due_date, po_number, invoice_status, f.plant_code
LIMIT 1""")
def q_invoice_lookup(v):
    """F11 detail of one invoice number (repeated number -> deterministic pick)."""
    return FL.invoice_lookup(v.invoice, v.vendor, INVOICE)


@register("invoice_exists", "F12", f"""
SELECT TRY_CAST('{INVOICE}' AS BIGINT) AS invoice_number,
       EXISTS (SELECT 1 FROM v_invoice WHERE invoice_number = {INVOICE}) AS found""")
def q_invoice_exists(v):
    """F12 existence probe."""
    return FL.invoice_exists(v.invoice, INVOICE)


@register("invoice_exists_missing", "F12+C9", """
SELECT TRY_CAST('7' AS BIGINT) AS invoice_number,
       EXISTS (SELECT 1 FROM v_invoice WHERE invoice_number = 7) AS found""")
def q_invoice_exists_missing(v):
    """F12 probe for an absent number typed as '7.0' (cleaned by C9)."""
    return FL.invoice_exists(v.invoice, "7.0".split(".")[0])


def _search_sql(where: str) -> str:
    return f"""
SELECT DISTINCT f.invoice_number, v.vendor_name, f.posting_date, f.due_date,
       CAST(f.invoice_amount_local AS DOUBLE) AS invoice_amount, f.purchase_order_reference AS po_number,
       upper(f.invoice_status) AS status
FROM v_invoice f LEFT JOIN v_vendor v ON f.vendor_id = v.vendor_id
WHERE {where}
ORDER BY posting_date DESC NULLS LAST, invoice_number ASC, vendor_name ASC NULLS LAST, due_date ASC NULLS LAST,
         invoice_amount ASC NULLS LAST, po_number ASC NULLS LAST, status ASC NULLS LAST
LIMIT 500"""


@register("invoice_search_all", "F13+U5+T4", _search_sql("1=1"))
def q_invoice_search_all(v):
    """F13 no filters: newest 500 distinct rows."""
    return FL.invoice_search(v.invoice, v.vendor, AS_OF, index=v.invoice_dates)


@register("invoice_search_status_index", "F13+F5", _search_sql("upper(f.invoice_status) = 'DISPUTED'"))
def q_invoice_search_status_index(v):
    """F13 by status, the newest dates from the zone index."""
    return FL.invoice_search(v.invoice, v.vendor, AS_OF, status="Disputed", index=v.invoice_dates)


@register("invoice_deep_page", "W6", """
SELECT invoice_number, vendor_id, posting_date, invoice_status FROM v_invoice
ORDER BY posting_date DESC NULLS LAST, invoice_number, vendor_id NULLS LAST LIMIT 25 OFFSET 2500""")
def q_invoice_deep_page(v):
    """W6 page 100 of 25 invoices by a page index: one range of the written rows is read."""
    rows = v.invoice.select("invoice_number", "vendor_id", "posting_date", "invoice_status")
    order = [F.col("posting_date").desc_nulls_last(), F.col("invoice_number").asc(),
             F.col("vendor_id").asc_nulls_last()]
    return page_index(rows, order).page(100, 25)


@register("invoice_search_vendor_status", "F13+F4+F5", _search_sql(
    f"upper(v.vendor_name) = upper('{VENDOR}') AND upper(f.invoice_status) = 'OVERDUE'"))
def q_invoice_search_vendor_status(v):
    """F13 vendor and status filters."""
    return FL.invoice_search(v.invoice, v.vendor, AS_OF, vendor=VENDOR, status="OVERDUE")


@register("invoice_search_due_next_30", "F13+F7", _search_sql(
    f"upper(f.invoice_status) = 'OPEN' AND f.due_date >= {A} AND f.due_date <= {A} + INTERVAL 30 DAY"))
def q_invoice_search_due(v):
    """F13 the DUE_NEXT_30 pseudo status."""
    return FL.invoice_search(v.invoice, v.vendor, AS_OF, status="DUE_NEXT_30")


@register("invoice_search_number", "F13", _search_sql(f"f.invoice_number = {INVOICE}"))
def q_invoice_search_number(v):
    """F13 by invoice number."""
    return FL.invoice_search(v.invoice, v.vendor, AS_OF, number=INVOICE)


@register("invoice_search_uncleaned_number", "F13+C9", _search_sql(f"f.invoice_number = {INVOICE}"))
def q_invoice_search_uncleaned(v):
    """F13 a number as a spreadsheet gives it, with a decimal point."""
    return FL.invoice_search(v.invoice, v.vendor, AS_OF, number=f"{INVOICE}.0")


@register("vendor_profile", "J4", f"""
SELECT * FROM (SELECT DISTINCT f.vendor_id, v.vendor_name, v.vendor_name_2, v.country_code, v.city,
                      v.postal_code, v.street
               FROM v_invoice f LEFT JOIN v_vendor v ON f.vendor_id = v.vendor_id
               WHERE f.invoice_number = {INVOICE})
ORDER BY vendor_id ASC NULLS LAST, vendor_name ASC NULLS LAST LIMIT 1""")
def q_vendor_profile(v):
    """J4 vendor record of one invoice."""
    return vendor_profile(v.invoice, v.vendor, INVOICE)


@register("company_plant_of_invoice", "J3", f"""
SELECT * FROM (SELECT DISTINCT f.company_code, cc.company_name, f.plant_code, plt.plant_name, cc.street,
                      cc.city, cc.postal_code
               FROM v_invoice f LEFT JOIN v_company cc ON f.company_code = cc.company_code
               LEFT JOIN v_plant plt ON f.plant_code = plt.plant_code
               WHERE f.invoice_number = {INVOICE})
ORDER BY company_code, plant_code LIMIT 1""")
def q_company_plant(v):
    """J3 company and plant of one invoice (DISTINCT, one row)."""
    from ledgerflow.operators.joins import with_company_plant
    hit = v.invoice.filter(F.col("invoice_number") == FL.invoice_key(INVOICE))
    j = with_company_plant(hit, v.company, v.plant)
    return (j.select("company_code", "company_name", "plant_code", "plant_name", "street", "city",
                     "postal_code").distinct().orderBy("company_code", "plant_code").limit(1))


@register("status_history", "I1", f"""
SELECT sequence_nbr, upper(status) AS status, effective_date, status_notes
FROM v_status_history WHERE invoice_number = {INVOICE}""")
def q_status_history(v):
    """I1 status history of one invoice."""
    return I.status_history(v.status_history, INVOICE)


HIST_DEFAULT_SQL = """
SELECT invoice_number, sequence_nbr, upper(status) AS status, effective_date, status_notes FROM v_status_history
UNION ALL
SELECT invoice_number, nbr, st, CASE nbr WHEN 1 THEN firsts.posting_date ELSE firsts.due_date END, note
FROM (SELECT invoice_number, arg_min(struct_pack(p := posting_date, d := due_date),
                                     (posting_date, COALESCE(due_date, DATE '0001-01-01'))) AS f
      FROM v_invoice i WHERE NOT EXISTS (SELECT 1 FROM v_status_history h WHERE h.invoice_number = i.invoice_number)
      GROUP BY invoice_number) x,
     LATERAL (SELECT x.f.p AS posting_date, x.f.d AS due_date) firsts,
     (VALUES (1, 'OPEN', 'Invoice opened.'), (2, 'OVERDUE', 'Invoice overdue.')) AS t(nbr, st, note)"""


@register("history_default", "I2", HIST_DEFAULT_SQL)
def q_history_default(v):
    """I2 every invoice's history, with defaults for those that have none."""
    return I.history_default(v.invoice, v.status_history)


@register("payable_flag", "I3", """
SELECT invoice_number, vendor_id, upper(invoice_status) AS invoice_status,
       COALESCE(upper(invoice_status) IN ('PAID','CLEARED','CLOSED','SETTLED'), FALSE) AS already_paid
FROM v_invoice""")
def q_payable_flag(v):
    """I3 already-paid flag for every invoice row."""
    return I.payable_flag(v.invoice)


@register("mark_paid_any_case", "U7", f"""
WITH due AS (SELECT DISTINCT invoice_number FROM v_invoice WHERE upper(invoice_status) = 'OPEN'
               AND due_date - {A} BETWEEN 0 AND 30),
h AS (SELECT invoice_number, sequence_nbr, CASE WHEN invoice_number % 2 = 0 THEN 'Paid' ELSE status END AS status,
             effective_date, 'Processed via payment run' AS status_notes FROM v_status_history)
SELECT * FROM h
UNION ALL SELECT invoice_number, 9, 'PAID', {A}, 'Processed via payment run' FROM due
WHERE invoice_number NOT IN (SELECT invoice_number FROM h WHERE lower(status) = 'paid')""")
def q_mark_paid_any_case(v):
    """U7 a stored 'Paid' row with the note is not paid again."""
    stored = v.status_history.withColumn(
        "status", F.when(F.col("invoice_number") % 2 == 0, F.lit("Paid")).otherwise(F.col("status"))).withColumn(
        "status_notes", F.lit("Processed via payment run"))
    return I.mark_paid(stored, FL.due_window(v.invoice, AS_OF), AS_OF)


@register("mark_paid", "U7", f"""
WITH due AS (SELECT DISTINCT invoice_number FROM v_invoice WHERE upper(invoice_status) = 'OPEN'
               AND due_date >= {A} AND due_date <= {A} + INTERVAL 30 DAY),
h AS (SELECT invoice_number, sequence_nbr, status, effective_date, status_notes FROM v_status_history),
new AS (SELECT invoice_number, 9 AS sequence_nbr, 'PAID' AS status, {A} AS effective_date,
               'Processed via payment run' AS status_notes FROM due)
SELECT * FROM h
UNION ALL SELECT * FROM new n WHERE NOT EXISTS (
  SELECT 1 FROM h WHERE h.invoice_number = n.invoice_number AND h.status = n.status
    AND h.status_notes = n.status_notes)""")
def q_mark_paid(v):
    """U7 append a PAID row for invoices due within 30 days, unless present."""
    to_pay = FL.due_window(v.invoice, AS_OF)
    return I.mark_paid(v.status_history, to_pay, AS_OF)


@register("invoice_360", "I4+J3+C30+I3", f"""
WITH r AS (SELECT *, COUNT(*) OVER (PARTITION BY invoice_number) AS row_count,
                  row_number() OVER (PARTITION BY invoice_number ORDER BY vendor_id NULLS FIRST,
                    invoice_amount_local NULLS FIRST, posting_date NULLS FIRST, due_date NULLS FIRST,
                    purchase_order_reference NULLS FIRST, po_amount NULLS FIRST, invoice_status NULLS FIRST,
                    aging_days NULLS FIRST, company_code NULLS FIRST, plant_code NULLS FIRST) AS rn
           FROM v_invoice)
SELECT r.invoice_number, r.row_count, r.posting_date AS invoice_date,
       CAST(r.invoice_amount_local AS DOUBLE) AS invoice_amount, r.purchase_order_reference AS po_number,
       CAST(r.po_amount AS DOUBLE) AS po_amount, r.due_date, upper(r.invoice_status) AS invoice_status,
       greatest(COALESCE(CAST(datediff('day', r.due_date, {A}) AS INTEGER), r.aging_days, 0), 0) AS aging_days,
       r.vendor_id, v.vendor_name, v.vendor_name_2, v.country_code, v.city,
       r.company_code, c.company_name, r.plant_code, p.plant_name, r.currency,
       COALESCE(upper(r.invoice_status) IN ('PAID','CLEARED','CLOSED','SETTLED'), FALSE) AS already_paid
FROM r LEFT JOIN v_company c ON r.company_code = c.company_code
LEFT JOIN v_plant p ON r.plant_code = p.plant_code
LEFT JOIN v_vendor v ON r.vendor_id = v.vendor_id
WHERE r.rn = 1""")
def q_invoice_360(v):
    """I4 one row per invoice number with vendor, company, plant and aging."""
    return I.invoice_360(v.invoice, v.vendor, v.company, v.plant, AS_OF)
