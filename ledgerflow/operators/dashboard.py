"""Dashboard operators A12-A14, A40-A43 (charts, needs-attention, vendor list).

Charts aggregate the fact first (partial aggregation before the shuffle),
so the window functions used for shares and forecasts only ever see a
handful of rows (status groups, months, top-10 vendors).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow import semantics as S
from ledgerflow.functions.scalars import status_group
from ledgerflow.operators.filters import (date_range, due_within, status_is,
                                          vendor_match)
from ledgerflow.operators.joins import names_of, with_vendor


def status_distribution(inv: DataFrame, start, end) -> DataFrame:
    """A12 status groups in the window: count and share % (1 dp, half-even).
    No vendor filter (R6)."""
    counts = (date_range(inv, start, end)
              .groupBy(status_group("invoice_status").alias("status"))
              .agg(F.count(F.lit(1)).alias("cnt")))
    return share_of_total(counts, "cnt", "percentage", digits=1)


def share_of_total(df: DataFrame, value: str, out: str = "percentage",
                   digits: int = 1) -> DataFrame:
    """W7 value / total * 100, rounded half-even. Meant for aggregated frames
    (a few rows); the total is a scalar subquery over the same frame."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, F.when(total > 0,
                                     F.bround(F.col(value).cast("double") / total * 100.0, digits))
                         .otherwise(F.lit(0.0)))


def spend_per_vendor(inv: DataFrame, ven: DataFrame, start, end,
                     vendor: str | None = None) -> DataFrame:
    """Window spend per vendor name ('Unknown' when unmatched), cancelled
    included: summed per vendor_id first, then joined to the dimension."""
    per_id = (date_range(inv, start, end).groupBy("vendor_id")
              .agg(F.sum(F.coalesce(F.col("invoice_amount_local"), F.lit(0))).alias("_s")))
    j = names_of(per_id, ven, vendor)
    return (j.groupBy(F.coalesce(F.col("vendor_name"), F.lit(S.UNKNOWN_VENDOR)).alias("vendor_name"))
            .agg(F.sum("_s").alias("spend")))


def top_vendors_spend(inv: DataFrame, ven: DataFrame, start, end, vendor: str | None = None,
                      k: int = S.TOP_VENDORS) -> DataFrame:
    """A13 spend by vendor name, top k by spend (ties by name, R11)."""
    agg = spend_per_vendor(inv, ven, start, end, vendor)
    return (agg.orderBy(F.col("spend").desc(), F.col("vendor_name").asc()).limit(k)
            .select("vendor_name", F.col("spend").cast("double").alias("spend")))


def spend_trend(inv: DataFrame, end: _dt.date, months: int = 6) -> DataFrame:
    """A14 monthly spend from add_months(end, -months), excluding cancelled /
    rejected; no upper bound (F8)."""
    f = inv.filter((F.col("posting_date") >= F.add_months(F.lit(end).cast("date"), -months))
                   & ~status_is(*S.EXCLUDED_FROM_SPEND))
    return (f.groupBy(F.trunc("posting_date", "MM").alias("month"))
            .agg(F.sum(F.coalesce(F.col("invoice_amount_local"), F.lit(0)))
                 .cast("double").alias("actual_spend"))
            .orderBy("month"))


def spend_forecast(trend: DataFrame) -> DataFrame:
    """W1 forecast_i = mean(actual_i, actual_i+1); the last month gets
    actual * 1.1. The month becomes a 'yyyy-MM' label. Input is one row per
    month (bounded), so the unpartitioned window is cheap."""
    w = Window.orderBy("month")
    nxt = F.lead("actual_spend").over(w)
    fc = F.when(nxt.isNull(), F.col("actual_spend") * float(S.FORECAST_LAST_FACTOR)) \
        .otherwise((F.col("actual_spend") + nxt) / 2.0)
    return trend.select(F.date_format("month", "yyyy-MM").alias("month"), "actual_spend",
                        fc.alias("forecast_spend"))


def vendor_list(inv: DataFrame, ven: DataFrame, start, end,
                include_all: bool = True) -> DataFrame:
    """A40 distinct vendor names with invoices in the window, sorted; the
    'All Vendors' choice heads the list (sort_key 0)."""
    j = names_of(date_range(inv, start, end).select("vendor_id").distinct(), ven)
    names = (j.filter(F.col("vendor_name").isNotNull()).select("vendor_name").distinct()
             .withColumn("sort_key", F.lit(1)))
    if include_all:
        head = ven.sparkSession.range(1).select(F.lit(S.ALL_VENDORS).alias("vendor_name"),
                                                 F.lit(0).alias("sort_key"))
        names = head.unionByName(names)
    return names.orderBy("sort_key", "vendor_name")


def vendor_names_all(ven: DataFrame) -> DataFrame:
    """A40 every vendor name of the dimension, sorted (the invoice page's
    filter list), with 'All Vendors' first."""
    names = ven.select("vendor_name").distinct().withColumn("sort_key", F.lit(1))
    head = ven.sparkSession.range(1).select(F.lit(S.ALL_VENDORS).alias("vendor_name"),
                                             F.lit(0).alias("sort_key"))
    return head.unionByName(names).orderBy("sort_key", F.col("vendor_name").asc_nulls_last())


def needs_attention(inv: DataFrame, ven: DataFrame, start, end, as_of: _dt.date,
                    vendor: str | None = None) -> DataFrame:
    """A41 OVERDUE / DISPUTED / DUE invoices in the window, one scan.

    The three categories are decided by disjoint statuses, so one CASE over
    a single scan equals the reference's three-way UNION ALL (U1)."""
    a = F.lit(as_of).cast("date")
    cat = (F.when((F.col("due_date") < a) & status_is(S.OVERDUE), F.lit(S.ATTENTION_OVERDUE))
           .when(status_is(*S.DISPUTE), F.lit(S.ATTENTION_DISPUTED))
           .when(due_within(as_of) & status_is(S.OPEN), F.lit(S.ATTENTION_DUE)))
    base = date_range(inv, start, end).withColumn("category", cat).filter(F.col("category").isNotNull())
    j = with_vendor(base, ven, vendor=vendor)
    return (j.select(F.col("invoice_number").alias("ref_no"),
                     F.col("invoice_amount_local").cast("double").alias("amount"),
                     "vendor_name", "due_date", "aging_days", "category")
            .orderBy(F.col("due_date").asc_nulls_last(), "ref_no"))


def needs_attention_union(inv: DataFrame, ven: DataFrame, start, end, as_of: _dt.date,
                          vendor: str | None = None) -> DataFrame:
    """U1 literal form of A41: three tagged branches, UNION ALL."""
    from ledgerflow.operators.setops import union_all_tagged
    a = F.lit(as_of).cast("date")
    j = with_vendor(date_range(inv, start, end), ven, vendor=vendor)
    cols = [F.col("invoice_number").alias("ref_no"),
            F.col("invoice_amount_local").cast("double").alias("amount"),
            "vendor_name", "due_date", "aging_days"]
    return union_all_tagged({
        S.ATTENTION_OVERDUE: j.filter((F.col("due_date") < a) & status_is(S.OVERDUE)).select(*cols),
        S.ATTENTION_DISPUTED: j.filter(status_is(*S.DISPUTE)).select(*cols),
        S.ATTENTION_DUE: j.filter(due_within(as_of) & status_is(S.OPEN)).select(*cols),
    }, "category")


def needs_attention_counts(attention: DataFrame) -> DataFrame:
    """A42 rows per category and the urgent total, one row."""
    def n(c):
        return F.sum(F.when(F.col("category") == c, 1).otherwise(0)).cast("bigint")
    return attention.agg(n(S.ATTENTION_OVERDUE).alias("overdue_count"),
                         n(S.ATTENTION_DISPUTED).alias("disputed_count"),
                         n(S.ATTENTION_DUE).alias("due_count"),
                         F.count(F.lit(1)).alias("urgent_total"))


def chart_pack(status: DataFrame, vendors: DataFrame, trend: DataFrame) -> DataFrame:
    """A43 the three chart inputs as one string table (col_a, col_b, col_c,
    _type) plus the numeric value coerced back (try_cast, R13)."""
    from ledgerflow.operators.setops import union_typed_null
    s = status.select(F.col("status").cast("string").alias("col_a"),
                      F.col("cnt").cast("string").alias("col_b"), F.lit("STATUS").alias("_type"))
    v = vendors.select(F.col("vendor_name").alias("col_a"),
                       F.col("spend").cast("string").alias("col_b"), F.lit("VENDOR").alias("_type"))
    t = trend.select(F.col("month").cast("string").alias("col_a"),
                     F.col("actual_spend").cast("string").alias("col_b"), F.lit("TREND").alias("_type"))
    packed = union_typed_null([s, v, t], {"col_c": "string"})
    return packed.withColumn("value", F.coalesce(F.col("col_b").try_cast("double"), F.lit(0.0)))


def spend_by_vendor_decimal(inv: DataFrame, ven: DataFrame, start, end,
                            vendor: str | None = None, k: int = S.TOP_VENDORS) -> DataFrame:
    """A13 with the spend kept as an exact decimal (input to A43's text form)."""
    agg = spend_per_vendor(inv, ven, start, end, vendor)
    return agg.orderBy(F.col("spend").desc(), F.col("vendor_name").asc()).limit(k)


def spend_trend_decimal(inv: DataFrame, end: _dt.date, months: int = 6) -> DataFrame:
    """A14 with the spend kept as an exact decimal."""
    f = inv.filter((F.col("posting_date") >= F.add_months(F.lit(end).cast("date"), -months))
                   & ~status_is(*S.EXCLUDED_FROM_SPEND))
    return (f.groupBy(F.trunc("posting_date", "MM").alias("month"))
            .agg(F.sum(F.coalesce(F.col("invoice_amount_local"), F.lit(0))).alias("actual_spend")))


__all__ = ["status_distribution", "share_of_total", "top_vendors_spend", "spend_trend",
           "spend_forecast", "vendor_list", "needs_attention", "needs_attention_union",
           "needs_attention_counts", "chart_pack", "vendor_match"]
