"""Registered queries for the sinks: results written with the library's
writers and read back (S5, S8, M10) and a presence filter (F10). Files go to a fresh folder under the session's shared
checkpoint directory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerflow import pages
from ledgerflow.operators.analysis import invoice_aging
from ledgerflow.operators.filters import invoice_search, not_null
from ledgerflow.operators.forecast import cash_flow_buckets
from ledgerflow.operators.kpi import kpi_summary
from ledgerflow.operators.state import append_log, log_rows
from ledgerflow.plans.q_analysis import AGING_SQL
from ledgerflow.plans.q_forecast import BUCKETS_SQL
from ledgerflow.plans.q_invoices import _search_sql
from ledgerflow.plans.q_kpi import _six, kpi_sql
from ledgerflow.plans.registry import AS_OF, END, START, register
from ledgerflow.sources.io import export_csv, scratch_path, write_table
from ledgerflow.sources.views import CatalogViews, write_views


def _fresh(spark, kind: str) -> str:
    return scratch_path(spark, "sinks", f"{kind}-{uuid.uuid4().hex}")


@register("paid_with_due_date", "F10", """
SELECT invoice_number, payment_date, due_date FROM v_invoice
WHERE payment_date IS NOT NULL AND due_date IS NOT NULL""")
def q_paid_with_due(v):
    """F10 presence filters on payment and due dates."""
    return not_null(v.invoice, "payment_date", "due_date").select("invoice_number", "payment_date",
                                                                    "due_date")


@register("write_table_read_back", "S5", """
SELECT invoice_number, vendor_id, posting_date, CAST(invoice_amount_local AS DOUBLE) AS amount
FROM v_invoice WHERE upper(invoice_status) = 'DISPUTED'""")
def q_write_table(v):
    """S5 write parquet (row count observed during the write) and read back."""
    path = _fresh(v.spark, "table")
    df = (v.invoice.filter(F.upper("invoice_status") == "DISPUTED")
          .select("invoice_number", "vendor_id", "posting_date",
                  F.col("invoice_amount_local").cast("double").alias("amount")))
    write_table(df, path)
    return v.spark.read.parquet(path)


CSV_SQL = f"""
SELECT forecast_bucket, CAST(invoice_count AS VARCHAR) AS invoice_count,
       printf('%.2f', total_amount) AS total_amount,
       CAST(earliest_due AS VARCHAR) AS earliest_due, CAST(latest_due AS VARCHAR) AS latest_due
FROM ({BUCKETS_SQL})"""


def _catalog(v) -> CatalogViews:
    folder = f"{v.base}/catalog"
    write_views(v, folder)
    return CatalogViews(v.spark, folder, AS_OF)


@register("views_kpi_summary", "S1+A10", kpi_sql(START, END))
def q_views_kpi(v):
    """A10 from the views as the source system names them."""
    return _six(kpi_summary(_catalog(v), START, END))


@register("views_invoice_aging", "S1+A36", AGING_SQL)
def q_views_aging(v):
    """A36 from the views as the source system names them."""
    return invoice_aging(_catalog(v).invoice, AS_OF)


@register("views_invoice_search", "S1+F13", _search_sql("upper(f.invoice_status) = 'OVERDUE'"))
def q_views_search(v):
    """F13 from the views as the source system names them."""
    own = _catalog(v)
    return invoice_search(own.invoice, own.vendor, AS_OF, status="OVERDUE")


@register("views_cash_flow", "S1+F18+A15", BUCKETS_SQL)
def q_views_cash_flow(v):
    """F18 the precomputed cash-flow view, used as it has rows."""
    return pages.cash_flow(_catalog(v))


@register("export_csv_read_back", "S8", CSV_SQL)
def q_export_csv(v):
    """S8 a report exported as CSV with a header, read back as text."""
    path = _fresh(v.spark, "csv")
    cf = cash_flow_buckets(v.invoice, AS_OF).withColumn(
        "total_amount", F.col("total_amount").cast("decimal(18,2)"))
    export_csv(cf, path, single_file=True)          # a 8-row report
    return v.spark.read.option("header", True).csv(path)


@register("append_log_read_back", "M10", """
SELECT lower(trim(query_text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS normalized_query, query_text, user_name, asked_at FROM v_question_history
UNION ALL
SELECT lower(trim(query_text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), query_text, user_name, asked_at FROM v_question_history""")
def q_append_log(v):
    """M10 two batches appended to a log table, read back."""
    path = _fresh(v.spark, "log")
    rows = log_rows(v.question_history)
    append_log(rows, path)
    append_log(rows, path)
    return v.spark.read.parquet(path)
