"""Invoice detail operators I1-I4 (history, defaults, payable flag, 360 view)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow import semantics as S
from ledgerflow.functions.scalars import detail_aging
from ledgerflow.operators.filters import invoice_key, status_is
from ledgerflow.operators.joins import with_company_plant

HISTORY_COLS = ("invoice_number", "sequence_nbr", "status", "effective_date", "status_notes")
(DEFAULT_OPEN, DEFAULT_OPEN_NOTE), (DEFAULT_OVERDUE, DEFAULT_OVERDUE_NOTE) = S.DEFAULT_HISTORY


def status_history(history: DataFrame, invoice_number) -> DataFrame:
    """I1 one invoice's history in sequence order, status upper-cased."""
    return (history.filter(F.col("invoice_number") == invoice_key(invoice_number))
            .select("sequence_nbr", F.upper("status").alias("status"), "effective_date",
                    "status_notes")
            .orderBy("sequence_nbr", "effective_date", "status_notes"))


def invoice_representative(inv: DataFrame, cols=("posting_date", "due_date")) -> DataFrame:
    """One row per invoice number (smallest ``cols`` tuple), aggregated
    partially before the shuffle so a repeated number costs no skew."""
    return (inv.groupBy("invoice_number")
            .agg(F.min(F.struct(*[F.col(c) for c in cols])).alias("_r"))
            .select("invoice_number", *[F.col(f"_r.{c}") for c in cols]))


def history_default(inv: DataFrame, history: DataFrame) -> DataFrame:
    """I2 every invoice's history; invoices with none get two synthesised rows:
    OPEN at the invoice date and OVERDUE at the due date.

    Which invoices have none comes from one map-side combined aggregate over
    the fact's and the history's numbers together, not from a join."""
    dates = F.struct("posting_date", "due_date")
    numbers = inv.select("invoice_number", dates.alias("_r"), F.lit(False).alias("_has")).unionByName(
        history.select("invoice_number", F.lit(True).alias("_has")), allowMissingColumns=True)
    missing = (numbers.groupBy("invoice_number").agg(F.min("_r").alias("_r"), F.bool_or("_has").alias("_has"))
               .filter(~F.col("_has")).select("invoice_number", "_r.posting_date", "_r.due_date"))
    rows = F.array(
        F.struct(F.lit(1).alias("sequence_nbr"), F.lit(DEFAULT_OPEN).alias("status"),
                 F.col("posting_date").alias("effective_date"),
                 F.lit(DEFAULT_OPEN_NOTE).alias("status_notes")),
        F.struct(F.lit(2).alias("sequence_nbr"), F.lit(DEFAULT_OVERDUE).alias("status"),
                 F.col("due_date").alias("effective_date"),
                 F.lit(DEFAULT_OVERDUE_NOTE).alias("status_notes")))
    synth = missing.select("invoice_number", F.explode(rows).alias("r")).select(
        "invoice_number", "r.*")
    real = history.select("invoice_number", "sequence_nbr", F.upper("status").alias("status"),
                          "effective_date", "status_notes")
    return real.unionByName(synth)


def payable_flag(inv: DataFrame) -> DataFrame:
    """I3 whether the invoice is already settled (no payment offered)."""
    return inv.select("invoice_number", "vendor_id", F.upper("invoice_status").alias("invoice_status"),
                      F.coalesce(status_is(*S.ALREADY_PAID), F.lit(False)).alias("already_paid"))


def mark_paid(history: DataFrame, to_pay: DataFrame, as_of: _dt.date,
              note: str = "Processed via payment run") -> DataFrame:
    """U7 batch form of 'Proceed to Pay': add a PAID row to each selected
    invoice unless a PAID row (in any letter case) with the same note exists."""
    from ledgerflow.operators.setops import append_if_absent
    new = to_pay.select("invoice_number").distinct().select(
        "invoice_number", F.lit(9).alias("sequence_nbr"), F.lit("PAID").alias("status"),
        F.lit(as_of).cast("date").alias("effective_date"), F.lit(note).alias("status_notes"))
    base = history.select(*HISTORY_COLS)
    # every new row is (PAID, note): only history rows with those values can
    # match; the note's literal predicate is pushed into the scan
    probe = base.filter((F.upper("status") == "PAID") & (F.col("status_notes") == note))
    return append_if_absent(base, new, ["invoice_number"], probe)


def invoice_360(inv: DataFrame, ven: DataFrame, company: DataFrame, plant: DataFrame,
                as_of: _dt.date) -> DataFrame:
    """I4 one row per invoice number: detail (F11) + vendor (J4) + company and
    plant (J3) + days past due (C30) + payable flag (I3). The representative
    row per number is picked with a partial ``min(struct)`` aggregate; the
    vendor dimension join is size-checked by AQE; company/plant are
    region/nation sized and broadcast."""
    detail_cols = ("vendor_id", "invoice_amount_local", "posting_date", "due_date",
                   "purchase_order_reference", "po_amount", "invoice_status", "aging_days",
                   "company_code", "plant_code", "currency")
    rep = (inv.groupBy("invoice_number")
           .agg(F.min(F.struct(*[F.col(c) for c in detail_cols])).alias("_r"),
                F.count(F.lit(1)).alias("row_count"))
           .select("invoice_number", "row_count", *[F.col(f"_r.{c}") for c in detail_cols]))
    j = with_company_plant(rep, company.select("company_code", "company_name"),
                           plant.select("plant_code", "plant_name"))
    j = j.join(ven.select("vendor_id", "vendor_name", "vendor_name_2", "country_code", "city"),
               "vendor_id", "left")
    return j.select(
        "invoice_number", "row_count", F.col("posting_date").alias("invoice_date"),
        F.col("invoice_amount_local").cast("double").alias("invoice_amount"),
        F.col("purchase_order_reference").alias("po_number"),
        F.col("po_amount").cast("double").alias("po_amount"), "due_date",
        F.upper("invoice_status").alias("invoice_status"),
        detail_aging("due_date", "aging_days", F.lit(as_of).cast("date")).alias("aging_days"),
        "vendor_id", "vendor_name", "vendor_name_2", "country_code", "city",
        "company_code", "company_name", "plant_code", "plant_name", "currency",
        F.coalesce(status_is(*S.ALREADY_PAID), F.lit(False)).alias("already_paid"))
