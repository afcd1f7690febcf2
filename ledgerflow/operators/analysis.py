"""Quick analyses and month-over-month drivers A28-A39.

Headlines (A30, A33, A35, A37) are computed inside the plan from the
already-aggregated monthly / top-10 frames; nothing is collected.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow import semantics as S
from ledgerflow.functions.scalars import ratio
from ledgerflow.operators.filters import status_is
from ledgerflow.operators.joins import full_outer_drivers, names_of
from ledgerflow.operators.windows import period_change, topn_share


def _a(as_of) -> Column:
    return F.lit(as_of).cast("date")


def _spend_rows(inv: DataFrame) -> DataFrame:
    return inv.filter(~status_is(*S.EXCLUDED_FROM_SPEND))


def _amount() -> Column:
    return F.coalesce(F.col("invoice_amount_local"), F.lit(0))


def monthly_spend(inv: DataFrame, as_of: _dt.date, months: int = 12) -> DataFrame:
    """A28 by posting month over the trailing months: spend, invoices,
    distinct vendors; newest first."""
    f = _spend_rows(inv).filter(F.col("posting_date") >= F.add_months(_a(as_of), -months))
    return (f.groupBy(F.trunc("posting_date", "MM").alias("month"))
            .agg(F.sum(_amount()).cast("double").alias("monthly_spend"),
                 F.count(F.lit(1)).alias("invoice_count"),
                 F.count_distinct("vendor_id").alias("vendor_count"))
            .orderBy(F.col("month").desc()))


def _ytd_rows(inv: DataFrame, as_of: _dt.date) -> DataFrame:
    return _spend_rows(inv).filter(F.col("posting_date") >= F.lit(_dt.date(as_of.year, 1, 1)))


def top_vendors_ytd(inv: DataFrame, ven: DataFrame, as_of: _dt.date,
                    k: int = S.TOP_VENDORS) -> DataFrame:
    """A29 calendar-YTD spend by vendor (grouped by the raw name, shown as
    'Unknown' when null), excluding cancelled / rejected; top k. Summed per
    vendor_id before the dimension join."""
    per_id = _ytd_rows(inv, as_of).groupBy("vendor_id").agg(F.sum(_amount()).alias("_s"))
    agg = names_of(per_id, ven).groupBy("vendor_name").agg(F.sum("_s").alias("_spend"))
    return (agg.orderBy(F.col("_spend").desc(), F.col("vendor_name").asc_nulls_last()).limit(k)
            .select(F.coalesce("vendor_name", F.lit(S.UNKNOWN_VENDOR)).alias("vendor_name"),
                    F.col("_spend").cast("double").alias("spend")))


def spending_headline(monthly: DataFrame, vendors: DataFrame) -> DataFrame:
    """A30 total of the top-10 list, top-5 share of it, MoM and QoQ change of
    the newest months (row based, W4)."""
    share = topn_share(vendors, "spend", "spend", 5).select(
        F.col("total").alias("total_ytd"), F.col("share").alias("top5_pct"))
    change = period_change(monthly, "month", "monthly_spend")
    return share.select("total_ytd", "top5_pct",
                        change.select("mom_pct").scalar().alias("mom_pct"),
                        change.select("qoq_pct").scalar().alias("qoq_pct"))


def vendor_analysis(inv: DataFrame, ven: DataFrame, as_of: _dt.date,
                    k: int = S.TOP_VENDORS) -> DataFrame:
    """A31 A29 plus distinct invoice count (pre-aggregated per vendor id and
    invoice number, so only distinct pairs reach the dimension join)."""
    pairs = (_ytd_rows(inv, as_of).groupBy("vendor_id", "invoice_number")
             .agg(F.sum(_amount()).alias("_s")))
    agg = (names_of(pairs, ven).groupBy("vendor_name")
           .agg(F.sum("_s").alias("_spend"), F.count_distinct("invoice_number").alias("invoice_count")))
    return (agg.orderBy(F.col("_spend").desc(), F.col("vendor_name").asc_nulls_last()).limit(k)
            .select(F.coalesce("vendor_name", F.lit(S.UNKNOWN_VENDOR)).alias("vendor_name"),
                    F.col("_spend").cast("double").alias("total_spend"), "invoice_count"))


def active_vendors_monthly(inv: DataFrame, as_of: _dt.date, months: int = 12) -> DataFrame:
    """A32 distinct vendor ids by posting month."""
    f = _spend_rows(inv).filter(F.col("posting_date") >= F.add_months(_a(as_of), -months))
    return (f.groupBy(F.trunc("posting_date", "MM").alias("month"))
            .agg(F.count_distinct("vendor_id").alias("active_vendors"))
            .orderBy(F.col("month").desc()))


def vendor_concentration(vendors: DataFrame, value: str = "total_spend") -> DataFrame:
    """A33 top-1 and top-5 share of the listed vendors' total, and row count."""
    one = topn_share(vendors, value, value, 1).select(
        F.col("total").alias("total_spend"), F.col("share").alias("top1_pct"))
    five = topn_share(vendors, value, value, 5).select("share").scalar()
    n = vendors.agg(F.count(F.lit(1))).scalar()
    return one.select("total_spend", "top1_pct", five.alias("top5_pct"), n.alias("active_vendors"))


def payment_performance(inv: DataFrame, as_of: _dt.date, months: int = 6) -> DataFrame:
    """A34 by payment month ('yyyy-MM'): mean days to pay (1 dp), late and
    total payments; excludes cancelled / rejected."""
    f = _spend_rows(inv).filter(F.col("payment_date").isNotNull()
                                & (F.col("payment_date") >= F.add_months(_a(as_of), -months)))
    agg = (f.groupBy(F.date_format("payment_date", "yyyy-MM").alias("month"))
           .agg(F.sum(F.datediff("payment_date", "posting_date")).alias("_days"),
                F.sum(F.when(F.datediff("payment_date", "due_date") > 0, 1).otherwise(0))
                .cast("bigint").alias("late_payments"),
                F.count(F.lit(1)).alias("total_payments")))
    return (agg.select("month",
                       F.round(F.col("_days").cast("double") / F.col("total_payments"), 1)
                       .alias("avg_days_to_pay"),
                       "late_payments", "total_payments",
                       F.date_format(F.to_date(F.concat("month", F.lit("-01"))), "MMM yyyy")
                       .alias("month_str"))
            .orderBy("month"))


def payment_headline(perf: DataFrame) -> DataFrame:
    """A35 mean of the monthly means, late share, totals."""
    return (perf.agg(F.sum(F.col("avg_days_to_pay").cast("decimal(20,1)")).alias("_sum_avg"),
                     F.count(F.lit(1)).alias("_months"),
                     F.sum("late_payments").alias("total_late"),
                     F.sum("total_payments").alias("total_payments"))
            .select((F.col("_sum_avg").cast("double") / F.col("_months")).alias("avg_days_to_pay"),
                    ratio("total_late", "total_payments", 100.0).alias("late_payments_pct"),
                    F.coalesce("total_late", F.lit(0)).cast("bigint").alias("total_late"),
                    F.coalesce("total_payments", F.lit(0)).cast("bigint").alias("total_payments")))


def aging_bucket(as_of) -> Column:
    a = _a(as_of)
    out = F.when(F.col("due_date") < a, F.lit(S.AGING_OVERDUE))
    for name, days in S.AGING_BUCKETS:
        out = out.when(F.col("due_date") <= F.date_add(a, days), F.lit(name))
    return out.otherwise(F.lit(S.AGING_ELSE))


def invoice_aging(inv: DataFrame, as_of: _dt.date) -> DataFrame:
    """A36 OPEN/DUE/OVERDUE invoices by due bucket (null due -> '>90')."""
    names = [S.AGING_OVERDUE] + [n for n, _ in S.AGING_BUCKETS] + [S.AGING_ELSE]
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + 1))])
    agg = (inv.filter(status_is(*S.UNPAID)).groupBy(aging_bucket(as_of).alias("aging_bucket"))
           .agg(F.count(F.lit(1)).alias("invoice_count"),
                F.sum(_amount()).cast("double").alias("total_amount")))
    return agg.withColumn("bucket_order", m[F.col("aging_bucket")]).orderBy("bucket_order")


def aging_headline(aging: DataFrame) -> DataFrame:
    """A37 open total, overdue amount and share, invoice count."""
    money = F.col("total_amount").cast("decimal(38,2)")
    row = aging.agg(F.coalesce(F.sum(money).cast("double"), F.lit(0.0)).alias("total_open"),
                    F.coalesce(F.sum(F.when(F.col("aging_bucket") == S.AGING_OVERDUE, money)).cast("double"),
                               F.lit(0.0)).alias("overdue_amount"),
                    F.coalesce(F.sum("invoice_count"), F.lit(0)).cast("bigint").alias("invoice_count"))
    return row.withColumn("overdue_pct", ratio("overdue_amount", "total_open", 100.0))


def latest_month_anchor(inv: DataFrame, as_of: _dt.date) -> DataFrame:
    """A38 newest posting month, else the month of as_of (one row)."""
    return inv.agg(F.coalesce(F.max(F.trunc("posting_date", "MM")), F.trunc(_a(as_of), "MM"))
                   .alias("anchor_month"))


def mom_drivers(inv: DataFrame, ven: DataFrame, as_of: _dt.date,
                k: int = S.TOP_DRIVERS) -> DataFrame:
    """A39 vendor spend in the anchor month vs the month before; top k by
    absolute change.

    The anchor month is a scalar subquery: Spark evaluates it once before
    the scan and pushes ``posting_date >= anchor - 1 month`` into the parquet
    reader (row groups outside the two months are skipped), with no driver
    round trip. Both months are conditional sums per vendor id, then per
    driver name, which equals the reference's FULL OUTER JOIN of two
    aggregates."""
    # one scalar subquery only: Spark merges several subqueries over the same
    # source into one struct-valued subquery, which is no longer pushable
    since = latest_month_anchor(inv, as_of).select(F.add_months("anchor_month", -1)).scalar()
    anchor = F.add_months(since, 1)            # exact: both are first days of months
    m = F.trunc("posting_date", "MM")
    f = _spend_rows(inv).filter(F.col("posting_date") >= since)
    is_this = m == anchor
    per_id = (f.groupBy("vendor_id")
              .agg(F.sum(F.when(is_this, _amount())).alias("_t0"),
                   F.sum(F.when(~is_this, _amount())).alias("_l0")))
    driver = F.coalesce(F.col("vendor_name"), F.lit(S.UNKNOWN_VENDOR))
    agg = (names_of(per_id, ven).groupBy(driver.alias("driver"))
           .agg(F.coalesce(F.sum("_t0"), F.lit(0)).alias("_t"),
                F.coalesce(F.sum("_l0"), F.lit(0)).alias("_l")))
    return _top_changes(agg.select("driver", F.col("_t").alias("this_month_spend"),
                                   F.col("_l").alias("last_month_spend"),
                                   (F.col("_t") - F.col("_l")).alias("spend_change")), k)


def mom_drivers_full_join(inv: DataFrame, ven: DataFrame, as_of: _dt.date,
                          k: int = S.TOP_DRIVERS) -> DataFrame:
    """A39 literal form: two monthly aggregates FULL OUTER JOINed (J6)."""
    since = latest_month_anchor(inv, as_of).select(F.add_months("anchor_month", -1)).scalar()
    anchor = F.add_months(since, 1)
    m = F.trunc("posting_date", "MM")
    f = _spend_rows(inv).filter(F.col("posting_date") >= since)
    driver = F.coalesce(F.col("vendor_name"), F.lit(S.UNKNOWN_VENDOR)).alias("driver")

    def month(cond):
        per_id = f.filter(cond).groupBy("vendor_id").agg(F.sum(_amount()).alias("_s"))
        return names_of(per_id, ven).groupBy(driver).agg(F.sum("_s").alias("spend"))

    this_m = month(m == anchor)
    last_m = month(m == F.add_months(anchor, -1))
    return _top_changes(full_outer_drivers(this_m, last_m), k)


def _top_changes(df: DataFrame, k: int) -> DataFrame:
    top = df.orderBy(F.abs(F.col("spend_change")).desc(), F.col("driver").asc()).limit(k)
    return top.select(F.lit(S.DRIVER_ROW_TYPE).alias("row_type"), "driver",
                      *[F.col(c).cast("double").alias(c)
                        for c in ("this_month_spend", "last_month_spend", "spend_change")])
