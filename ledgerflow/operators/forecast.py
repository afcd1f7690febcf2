"""Forecast and GR/IR operators A15-A27.

The fact-level operators aggregate first (bucket or month keys, a few
groups), so the TOTAL row, orderings and headline ratios run over a
handful of rows. GR/IR operators read the monthly rollups (one row per
month).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow import semantics as S
from ledgerflow.functions.scalars import ratio, ym_label
from ledgerflow.operators.filters import status_is
from ledgerflow.operators.joins import latest_pair, names_of, with_vendor


def _as_of(as_of) -> Column:
    return F.lit(as_of).cast("date")


def cash_flow_bucket(days: Column) -> Column:
    """Bucket code for days until due (upper edges inclusive)."""
    out = None
    for name, edge in S.CASH_FLOW_BUCKETS:
        cond = days < 0 if edge < 0 else days <= edge
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(S.CASH_FLOW_ELSE))


def cash_flow_buckets(inv: DataFrame, as_of: _dt.date) -> DataFrame:
    """A15 unpaid invoices with a due date, by due bucket: count, sum, min and
    max due; plus the TOTAL_UNPAID row with null dates (U2). Without an unpaid
    invoice that row alone is there, with nulls."""
    base = inv.filter(status_is(*S.UNPAID) & F.col("due_date").isNotNull())
    bucket = cash_flow_bucket(F.datediff(F.col("due_date"), _as_of(as_of)))
    # one pass: the empty grouping set of the rollup is the total
    rolled = (base.select(bucket.alias("_bucket"), "invoice_amount_local", "due_date").rollup("_bucket")
              .agg(F.count(F.lit(1)).alias("invoice_count"),
                   F.sum("invoice_amount_local").cast("double").alias("total_amount"),
                   F.min("due_date").alias("_first"), F.max("due_date").alias("_last"),
                   F.grouping("_bucket").alias("_total")))
    # a rollup of no rows has no total: one row of nulls, merged with the total where there is one
    none = base.sparkSession.range(1).select(
        *[F.lit(None).cast(rolled.schema[c].dataType).alias(c) for c in rolled.columns[:-1]],
        F.lit(1).cast(rolled.schema["_total"].dataType).alias("_total"))
    rolled = (rolled.unionByName(none).groupBy("_bucket", "_total")
              .agg(*[F.max(c).alias(c) for c in ("invoice_count", "total_amount", "_first", "_last")]))
    total = F.col("_total") == 1
    return rolled.select(
        F.when(total, F.lit(S.CASH_FLOW_TOTAL)).otherwise(F.col("_bucket")).alias("forecast_bucket"),
        "invoice_count", "total_amount", F.when(~total, F.col("_first")).alias("earliest_due"),
        F.when(~total, F.col("_last")).alias("latest_due"))


def cash_flow_ordered(buckets: DataFrame) -> DataFrame:
    """A16 rows in the fixed bucket order, with the order as a column (T2)."""
    order = F.create_map(*[x for i, b in enumerate(S.CASH_FLOW_ORDER)
                           for x in (F.lit(b), F.lit(i))])
    rank = F.coalesce(order[F.col("forecast_bucket")], F.lit(len(S.CASH_FLOW_ORDER)))
    return buckets.withColumn("bucket_order", rank).orderBy("bucket_order")


def cash_flow_headline(buckets: DataFrame) -> DataFrame:
    """A17 total unpaid, overdue now, due within 30 days and its share."""
    def amt(*names):
        # exact decimal sum of the bucket amounts, so the total does not
        # depend on the order the rows are added in
        money = F.col("total_amount").cast("decimal(38,2)")
        return F.coalesce(F.sum(F.when(F.col("forecast_bucket").isin(*names), money)).cast("double"),
                          F.lit(0.0))
    row = buckets.agg(amt(S.CASH_FLOW_TOTAL).alias("total_unpaid"),
                      amt("OVERDUE_NOW").alias("overdue_now"),
                      amt(*S.CASH_FLOW_NEAR).alias("due_30_days"))
    return row.withColumn("pct_due_30", ratio("due_30_days", "total_unpaid", 100.0))


def early_payment_priority(days: Column) -> Column:
    out = None
    for name, edge in S.EARLY_PAY_PRIORITY:
        out = F.when(days <= edge, F.lit(name)) if out is None else out.when(days <= edge, F.lit(name))
    return out.otherwise(F.lit(S.EARLY_PAY_PRIORITY_ELSE))


def early_payment(inv: DataFrame, ven: DataFrame, as_of: _dt.date, rate: str = S.EARLY_PAY_RATE,
                  k: int = S.EARLY_PAY_ROWS) -> DataFrame:
    """A18 OPEN/DUE invoices due in 1..30 days: saving at ``rate`` (exact
    decimal, cents), priority High/Medium/Low; ordered by priority text
    (High, Low, Medium as in the reference), then saving desc; top k."""
    a = _as_of(as_of)
    days = F.datediff(F.col("due_date"), a)
    base = inv.filter(status_is(*S.OPEN_OR_DUE) & (F.col("due_date") > a) & (days <= S.DUE_SOON_DAYS))
    j = with_vendor(base, ven)
    sel = j.select(F.col("invoice_number").cast("string").alias("document_number"),
                   "vendor_name",
                   F.col("invoice_amount_local").alias("_amt"),
                   "due_date",
                   days.alias("days_until_due"),
                   F.round(F.col("invoice_amount_local") * F.lit(rate).cast("decimal(4,2)"), 2)
                   .alias("_saving"),
                   early_payment_priority(days).alias("early_pay_priority"))
    top = sel.orderBy(F.col("early_pay_priority").asc(), F.col("_saving").desc(),
                      F.col("document_number").asc(), F.col("vendor_name").asc_nulls_last(),
                      F.col("due_date").asc(), F.col("_amt").asc()).limit(k)
    return top.select("document_number", "vendor_name",
                      F.col("_amt").cast("double").alias("invoice_amount"), "due_date",
                      "days_until_due",
                      F.col("_saving").cast("double").alias("savings_if_2pct_discount"),
                      "early_pay_priority")


def early_payment_headline(early: DataFrame) -> DataFrame:
    """A19 total saving and number of High-priority rows."""
    return early.agg(F.coalesce(F.sum(F.col("savings_if_2pct_discount").cast("decimal(18,2)")),
                                F.lit(0)).cast("double").alias("total_savings"),
                     F.sum(F.when(F.col("early_pay_priority") == "High", 1).otherwise(0))
                     .cast("bigint").alias("high_priority"))


def _window_label(as_of, windows, overdue, otherwise) -> Column:
    a = _as_of(as_of)
    out = F.when(F.col("due_date") < a, F.lit(overdue))
    for name, days in windows:
        out = out.when(F.col("due_date") <= F.date_add(a, days), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def _order_of(col: str, names) -> Column:
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + 1))])
    return F.coalesce(m[F.col(col)], F.lit(len(names) + 1))


def payment_timing(inv: DataFrame, as_of: _dt.date) -> DataFrame:
    """A20 OPEN/DUE invoices by payment window (null due date -> later)."""
    lab = _window_label(as_of, S.PAYMENT_WINDOWS, S.PAYMENT_WINDOW_OVERDUE, S.PAYMENT_WINDOW_ELSE)
    names = [S.PAYMENT_WINDOW_OVERDUE] + [n for n, _ in S.PAYMENT_WINDOWS]
    agg = (inv.filter(status_is(*S.OPEN_OR_DUE)).groupBy(lab.alias("payment_window"))
           .agg(F.count(F.lit(1)).alias("invoice_count"),
                F.sum("invoice_amount_local").cast("double").alias("total_amount")))
    return agg.withColumn("window_order", _order_of("payment_window", names)).orderBy("window_order")


def late_payment_trend(inv: DataFrame, as_of: _dt.date, months: int = 12) -> DataFrame:
    """A21 payments by month over the trailing months: total, late (paid after
    due; null due is not late), mean late days of late ones, late %."""
    a = _as_of(as_of)
    late = F.col("payment_date") > F.col("due_date")
    f = inv.filter(F.col("payment_date").isNotNull()
                   & (F.col("payment_date") >= F.add_months(a, -months)))
    agg = (f.groupBy(F.trunc("payment_date", "MM").alias("month"))
           .agg(F.count(F.lit(1)).alias("total_payments"),
                F.sum(F.when(late, 1).otherwise(0)).cast("bigint").alias("late_payments"),
                F.sum(F.when(late, F.datediff("payment_date", "due_date"))).alias("_late_days")))
    return agg.select("month", "total_payments", "late_payments",
                      (F.col("_late_days").cast("double") / F.col("late_payments")).alias("avg_late_days"),
                      (F.col("late_payments").cast("double") / F.col("total_payments") * 100.0)
                      .alias("late_pct")).orderBy("month")


def grir_hotspots(balance: DataFrame, label_rows: int = 12) -> DataFrame:
    """A22 balance by month, newest first; 'yyyy-MM' label on the newest 12.
    One row per month, so the unpartitioned rank is over a bounded frame."""
    w = Window.orderBy(F.col("year").desc(), F.col("month").desc())
    rn = F.row_number().over(w)
    return (balance.select("year", "month", "invoice_count",
                           F.col("total_grir_blnc").cast("double").alias("total_grir_balance"))
            .withColumn("month_rank", rn)
            .withColumn("label", F.when(F.col("month_rank") <= label_rows,
                                        ym_label("year", "month")))
            .orderBy("month_rank"))


def grir_position(balance: DataFrame, aging: DataFrame) -> DataFrame:
    """A23 newest balance month with its aging (null when the newest aging
    month differs) and the amount over 60 days = balance x fraction."""
    j = latest_pair(balance, aging)
    return j.select("year", "month", F.col("invoice_count").alias("grir_items"),
                    F.col("total_grir_blnc").cast("double").alias("total_grir_balance"),
                    "pct_grir_over_60", "cnt_grir_over_60",
                    F.coalesce(F.col("total_grir_blnc").cast("double") * F.col("pct_grir_over_60"),
                               F.lit(0.0)).alias("amount_over_60_days"))


def grir_trend(balance: DataFrame, n: int = S.GRIR_TREND_ROWS) -> DataFrame:
    """A24 newest n months."""
    return (balance.orderBy(F.col("year").desc(), F.col("month").desc()).limit(n)
            .select("year", "month", "invoice_count",
                    F.col("total_grir_blnc").cast("double").alias("total_grir_blnc")))


def grir_root_cause_inputs(balance: DataFrame, aging: DataFrame,
                           n: int = S.GRIR_ROOT_ROWS) -> DataFrame:
    """A25 newest n aging rows and newest n balance rows, joined on month."""
    a = aging.orderBy(F.col("year").desc(), F.col("month").desc()).limit(n)
    b = (balance.orderBy(F.col("year").desc(), F.col("month").desc()).limit(n)
         .select("year", "month", F.col("total_grir_blnc").cast("double").alias("total_grir_blnc")))
    return a.join(b, ["year", "month"], "full")


def grir_working_capital(balance: DataFrame, as_of: _dt.date, mode: str = "yyyymm") -> DataFrame:
    """A26 balance released by clearing items older than 60 / 90 days.

    mode 'yyyymm' keeps the reference's integer arithmetic on year*100+month
    (yyyymm(as_of) - 60); mode 'days' ages each month by its last day."""
    bal = F.col("total_grir_blnc").cast("double")
    if mode == "yyyymm":
        cur = as_of.year * 100 + as_of.month
        ym = F.col("year") * 100 + F.col("month")
        o60, o90 = ym <= cur - 60, ym <= cur - 90
    elif mode == "days":
        age = F.datediff(_as_of(as_of), F.last_day(F.make_date("year", "month", F.lit(1))))
        o60, o90 = age > 60, age > 90
    else:
        raise ValueError(mode)
    return (balance.select("year", "month", bal.alias("total_grir_blnc"),
                           F.when(o60, bal).otherwise(F.lit(0.0)).alias("older_than_60_days"),
                           F.when(o90, bal).otherwise(F.lit(0.0)).alias("older_than_90_days"))
            .orderBy(F.col("year").desc(), F.col("month").desc()))


def grir_working_capital_totals(wc: DataFrame) -> DataFrame:
    """A26 totals over all months."""
    def total(c):
        return F.coalesce(F.sum(F.col(c).cast("decimal(38,2)")).cast("double"), F.lit(0.0))
    return wc.agg(total("older_than_60_days").alias("older_60"),
                  total("older_than_90_days").alias("older_90"))


def grir_vendor_followup(inv: DataFrame, ven: DataFrame, as_of: _dt.date,
                         k: int = S.TOP_VENDORS) -> DataFrame:
    """A27 OPEN invoices with a PO by vendor name (null name is its own group):
    count, sum, mean age in days; top k by amount."""
    a = _as_of(as_of)
    base = inv.filter(status_is(S.OPEN) & F.col("purchase_order_reference").isNotNull())
    per_id = (base.groupBy("vendor_id")
              .agg(F.count(F.lit(1)).alias("_n"), F.sum("invoice_amount_local").alias("_a"),
                   F.sum(F.datediff(a, F.col("posting_date"))).alias("_g")))
    agg = (names_of(per_id, ven).groupBy("vendor_name")
           .agg(F.sum("_n").alias("grir_count"), F.sum("_a").alias("_amt"), F.sum("_g").alias("_age")))
    return (agg.orderBy(F.col("_amt").desc_nulls_last(), F.col("vendor_name").asc_nulls_last())
            .limit(k)
            .select("vendor_name", "grir_count", F.col("_amt").cast("double").alias("total_amount"),
                    (F.col("_age").cast("double") / F.col("grir_count")).alias("avg_age_days")))
