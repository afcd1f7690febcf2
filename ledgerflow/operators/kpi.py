"""Executive KPIs A1-A11.

The reference runs four one-row aggregates and CROSS JOINs them
(J5). Here the fact aggregates A1-A5 and the cycle-time fallback A7 are
conditional aggregates of a single scan of fact LEFT JOIN vendor; the
vendor filter (R5) becomes a condition inside the aggregates so the same
scan also serves the unfiltered A7. Distinct counts are planned by
Catalyst as an Expand + two-phase aggregate (partial aggregation happens
before the shuffle). The monthly rollups are small (one row per month).

Where the views keep day partials (``day_partials``, written beside the
fact), A2-A5, A10 and A11 without a vendor filter read those rows only.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow import semantics as S
from ledgerflow.functions.scalars import fixed_text, pct_delta, ratio
from ledgerflow.operators.filters import prior_window, status_is, year_month_between
from ledgerflow.operators.joins import names_of, selected_vendors

KPI_COLUMNS = ("total_spend", "active_pos", "total_pos", "pending_inv", "active_vendors",
               "avg_processing_days", "first_pass_rate", "auto_rate")


def _in_range(start, end, col="posting_date") -> Column:
    return F.col(col).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def spend_amount() -> Column:
    """A1 term: amount unless status is CANCELLED/REJECTED; null amount -> 0;
    null status -> 0 (R2, R3)."""
    keep = ~status_is(*S.EXCLUDED_FROM_SPEND)
    return F.when(keep, F.coalesce(F.col("invoice_amount_local"), F.lit(0))).otherwise(F.lit(0))


def kpi_total_spend(inv: DataFrame) -> Column:
    """A1."""
    return F.sum(spend_amount()).cast("double").alias("total_spend")


def kpi_active_pos(inv: DataFrame = None) -> Column:
    """A2 distinct PO where status is OPEN."""
    return F.count_distinct(F.when(status_is(S.OPEN), F.col("purchase_order_reference"))) \
        .alias("active_pos")


def kpi_total_pos(inv: DataFrame = None) -> Column:
    """A3 distinct PO (nulls ignored)."""
    return F.count_distinct(F.col("purchase_order_reference")).alias("total_pos")


def kpi_pending_inv(inv: DataFrame = None) -> Column:
    """A4 distinct invoice number where OPEN."""
    return F.count_distinct(F.when(status_is(S.OPEN), F.col("invoice_number"))) \
        .alias("pending_inv")


def kpi_active_vendors(inv: DataFrame = None) -> Column:
    """A5 distinct non-null vendor name."""
    return F.count_distinct(F.col("vendor_name")).alias("active_vendors")


def fact_kpis(inv: DataFrame, ven: DataFrame, start, end, vendor: str | None = None) -> DataFrame:
    """A1-A5 plus the A7 fallback inputs from one scan of the fact.

    Without a vendor filter the fact is not joined to the vendor dimension
    at all: A5 counts names over the distinct vendor ids of the window
    (aggregate first, then join). With a filter, the matching vendor ids
    (a tiny frame AQE broadcasts) are left-joined as a flag, so the same scan
    still serves the unfiltered A7 fallback."""
    f = inv.filter(_in_range(start, end))
    if vendor is None:
        base, sel = f, F.lit(True)
    else:
        base = f.join(selected_vendors(ven, vendor), "vendor_id", "left")
        sel = F.col("_sel_name").isNotNull()

    def only(c: Column) -> Column:
        return F.when(sel, c)

    cleared = status_is(*S.CLEARED) & F.col("payment_date").isNotNull()
    fb_days = F.when(cleared, F.datediff("payment_date", "posting_date"))
    aggs = [
        F.coalesce(F.sum(only(spend_amount())), F.lit(0)).cast("double").alias("total_spend"),
        F.count_distinct(only(F.when(status_is(S.OPEN), F.col("purchase_order_reference"))))
        .alias("active_pos"),
        F.count_distinct(only(F.col("purchase_order_reference"))).alias("total_pos"),
        F.count_distinct(only(F.when(status_is(S.OPEN), F.col("invoice_number"))))
        .alias("pending_inv"),
        F.sum(fb_days).alias("_fb_days"),
        F.count(fb_days).alias("_fb_n")]
    if vendor is not None:
        return base.agg(*aggs, F.count_distinct("_sel_name").alias("active_vendors"))
    names = names_of(f.select("vendor_id").distinct(), ven).agg(F.count_distinct("vendor_name"))
    return base.agg(*aggs, names.scalar().alias("active_vendors"))


def kpi_cycle_days(cycle: DataFrame, start, end) -> DataFrame:
    """A6 unweighted mean of the monthly average cycle times in the window."""
    return (cycle.filter(year_month_between(start, end))
            .agg(F.avg(F.col("avg_payment_cycle_time_days").cast("double")).alias("avg_days")))


def kpi_cycle_fallback(inv: DataFrame, start, end) -> DataFrame:
    """A7 mean (payment - posting) days of PAID/CLEARED invoices in the window."""
    d = F.datediff("payment_date", "posting_date")
    f = inv.filter(_in_range(start, end) & status_is(*S.CLEARED) & F.col("payment_date").isNotNull())
    return f.agg((F.sum(d).cast("double") / F.count(d)).alias("avg_days"))


def kpi_first_pass(full_payment: DataFrame, start, end) -> DataFrame:
    """A8 sums of full-paid and cleared counts over the window's months."""
    return (full_payment.filter(year_month_between(start, end))
            .agg(F.sum(F.col("full_paid_invoices").cast("bigint")).alias("fp_full_paid"),
                 F.sum(F.col("total_cleared_invoices").cast("bigint")).alias("fp_total_cleared")))


def kpi_auto_rate(history: DataFrame, start, end) -> DataFrame:
    """A9 PAID/CLEARED history rows in the window and those auto processed."""
    h = history.filter(_in_range(start, end) & status_is(*S.CLEARED, col="status"))
    return h.agg(F.count(F.lit(1)).alias("auto_total"),
                 F.sum(F.when(F.upper("status_notes") == S.AUTO_PROCESSED_NOTE, 1).otherwise(0))
                 .cast("bigint").alias("auto_processed"))


def _first_seen(rows: DataFrame, id_col: str, flags: dict[str, Column]) -> DataFrame:
    """(measure, posting_date, previous_date, n): of the ids that a measure's
    flag marks on a date, how many it marked last on ``previous_date`` (null:
    never before). An id has at most one row a date here, so its window is as
    long as the calendar, however many fact rows it has."""
    days = rows.filter(F.col(id_col).isNotNull()).groupBy(id_col, "posting_date").agg(
        *[F.max(flag).alias(m) for m, flag in flags.items()])
    before = Window.partitionBy(id_col).orderBy("posting_date").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col(m), F.max(F.when(F.col(m), F.col("posting_date"))).over(before)).alias(f"_{m}")
            for m in flags]
    counted = (days.select("posting_date", *flags, *last)
               .groupBy("posting_date", *flags, *[f"_{m}" for m in flags]).agg(F.count(F.lit(1)).alias("n")))
    seen = F.array(*[F.when(F.col(m), F.struct(F.lit(m).alias("measure"), F.col(f"_{m}").alias("previous_date")))
                     for m in flags])
    return (counted.select("posting_date", "n", F.explode(F.filter(seen, lambda x: x.isNotNull())).alias("s"))
            .groupBy("s.measure", "posting_date", "s.previous_date").agg(F.sum("n").alias("n")))


def _stacked(days: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row a date -> one row a (date, measure)."""
    e = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("decimal(38,2)").alias("n")) for m, c in measures.items()])
    return days.select("posting_date", F.explode(e).alias("e")).select(
        "e.measure", "posting_date", F.lit(None).cast("date").alias("previous_date"), "e.n")


def day_partials(inv: DataFrame, ven: DataFrame, history: DataFrame) -> DataFrame:
    """A1-A5, A7 and A9 as daily rows (measure, posting_date, previous_date, n)
    from which any window's exact values add up.

    Sums and counts of rows have no ``previous_date``. A distinct count keeps,
    per date, its ids by the date on which they were last seen: the window
    [s, e] counts an id once, on its first date there, that is where the
    previous date is null or before s. The rows are bounded by the pairs of
    dates, not by ids or facts, and unlike bitmaps over document numbers they
    do not depend on how the numbers lie. Undated rows belong to no window."""
    f = inv.filter(F.col("posting_date").isNotNull())
    is_open = F.coalesce(status_is(S.OPEN), F.lit(False))
    orders = _first_seen(f, "purchase_order_reference", {"total_pos": F.lit(True), "active_pos": is_open})
    pending = _first_seen(f.filter(is_open), "invoice_number", {"pending_inv": F.lit(True)})
    named = names_of(f.select("vendor_id", "posting_date").distinct(), ven)
    vendors = _first_seen(named, "vendor_name", {"active_vendors": F.lit(True)})
    cleared = status_is(*S.CLEARED) & F.col("payment_date").isNotNull()
    days = F.when(cleared, F.datediff("payment_date", "posting_date"))
    sums = f.groupBy("posting_date").agg(F.sum(spend_amount()).alias("spend"), F.sum(days).alias("paid_days"),
                                         F.count(days).alias("paid"))
    auto = (history.filter(F.col("posting_date").isNotNull() & status_is(*S.CLEARED, col="status"))
            .groupBy("posting_date")
            .agg(F.count(F.lit(1)).alias("auto_total"),
                 F.count_if(F.upper("status_notes") == S.AUTO_PROCESSED_NOTE).alias("auto_processed")))
    counts = orders.unionByName(pending).unionByName(vendors).withColumn("n", F.col("n").cast("decimal(38,2)"))
    return (counts.unionByName(_stacked(sums, {m: F.col(m) for m in ("spend", "paid_days", "paid")}))
            .unionByName(_stacked(auto, {m: F.col(m) for m in ("auto_total", "auto_processed")})))


def _written_days(v) -> DataFrame | None:
    """The day partials of views that keep them written."""
    return v.kpi_days if getattr(v, "materialize", False) else None


def _daily_side(days: DataFrame, windows) -> DataFrame:
    """A1-A5 and the inputs of A7 and A9 per tag, added up from day partials."""
    lo = min(s for _, s, _ in windows)
    hi = max(e for _, _, e in windows)
    previous = F.col("previous_date")
    rows = _tagged(days.filter(_in_range(lo, hi)), windows,
                   lambda s, e: _in_range(s, e) & (previous.isNull() | (previous < F.lit(s).cast("date"))))

    def total(measure: str) -> Column:
        return F.sum(F.when(F.col("measure") == measure, F.col("n")))

    counts = ("active_pos", "total_pos", "pending_inv", "active_vendors", "auto_total", "auto_processed")
    return rows.groupBy("tag").agg(
        total("spend").alias("_spend"), *[total(c).cast("bigint").alias(c) for c in counts],
        total("paid_days").cast("bigint").alias("_fb_days"), total("paid").cast("bigint").alias("_fb_n"))


def distinct_counts(v, start: _dt.date, end: _dt.date) -> DataFrame:
    """A2-A5 of a window: from day partials where the views keep them, else
    from the fact."""
    names = ("active_pos", "total_pos", "pending_inv", "active_vendors")
    days = _written_days(v)
    if days is None:
        return fact_kpis(v.invoice, v.vendor, start, end).select(*names)
    # a window without rows has no tag: the outer aggregate still gives a row
    return _daily_side(days, [("cur", start, end)]).agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("bigint")).alias(c) for c in names])


def _tagged(df: DataFrame, windows, member) -> DataFrame:
    """Each row once per window it belongs to (``member(start, end)`` is the
    membership test), as column ``tag``. Disjoint windows never duplicate a
    row; overlapping ones duplicate only the shared rows."""
    tags = F.array(*[F.when(member(s, e), F.lit(t)) for t, s, e in windows])
    return df.withColumn("tag", F.explode(F.filter(tags, lambda x: x.isNotNull())))


def _fact_side(v, windows, vendor: str | None) -> DataFrame:
    """A1-A5 and the A7 inputs per tag from one pass over the fact.

    Each row becomes three entries (its order, its invoice, its vendor); the
    sums ride on the first. Entries are aggregated per (tag, kind, id), map
    side first, so what is shuffled is one row per distinct id, and all
    distinct counts are plain counts of those rows."""
    lo = min(s for _, s, _ in windows)
    hi = max(e for _, _, e in windows)
    f = _tagged(v.invoice.filter(_in_range(lo, hi)), windows, lambda s, e: _in_range(s, e))
    if vendor is None:
        base, sel = f, F.lit(True)
    else:
        base = f.join(selected_vendors(v.vendor, vendor), "vendor_id", "left")
        sel = F.col("_sel_name").isNotNull()
    is_open = F.coalesce(status_is(S.OPEN), F.lit(False))
    cleared = status_is(*S.CLEARED) & F.col("payment_date").isNotNull()
    days = F.when(cleared, F.datediff("payment_date", "posting_date"))

    def entry(kind: str, id_col: str, open_only: bool = False) -> Column:
        keep = sel & is_open if open_only else sel
        return F.struct(F.lit(kind).alias("kind"), F.when(keep, F.col(id_col).cast("string")).alias("id"),
                        (sel & is_open).alias("open"))

    entries = F.array(entry("po", "purchase_order_reference"), entry("inv", "invoice_number", True),
                      entry("ven", "vendor_id"))
    rows = base.select("tag", F.when(sel, spend_amount()).alias("_spend"), days.alias("_days"),
                       F.posexplode(entries).alias("_i", "e"))
    first = F.col("_i") == 0
    ids = rows.groupBy("tag", "e.kind", "e.id").agg(
        F.max("e.open").alias("_open"), F.sum(F.when(first, F.col("_spend"))).alias("_spend"),
        F.sum(F.when(first, F.col("_days"))).alias("_fb_days"),
        F.count(F.when(first, F.col("_days"))).alias("_fb_n"))
    ven = v.vendor.select(F.col("vendor_id").alias("_vendor_id"), "vendor_name")
    named = ids.join(ven, (F.col("kind") == "ven") & (F.col("id") == F.col("_vendor_id")), "left")

    def known(kind: str) -> Column:
        return (F.col("kind") == kind) & F.col("id").isNotNull()

    return named.groupBy("tag").agg(
        F.sum("_spend").alias("_spend"), F.count_if(known("po") & F.col("_open")).alias("active_pos"),
        F.count_if(known("po")).alias("total_pos"), F.count_if(known("inv")).alias("pending_inv"),
        F.count_distinct("vendor_name").alias("active_vendors"),
        F.sum("_fb_days").alias("_fb_days"), F.sum("_fb_n").alias("_fb_n"))


def _auto_side(history: DataFrame, windows) -> DataFrame:
    """A9 counts per tag from the status history."""
    lo = min(s for _, s, _ in windows)
    hi = max(e for _, _, e in windows)
    h = history.filter(_in_range(lo, hi) & status_is(*S.CLEARED, col="status"))
    return (_tagged(h, windows, lambda s, e: _in_range(s, e)).groupBy("tag")
            .agg(F.count(F.lit(1)).alias("auto_total"),
                 F.sum(F.when(F.upper("status_notes") == S.AUTO_PROCESSED_NOTE, 1).otherwise(0))
                 .cast("bigint").alias("auto_processed")))


def kpi_multi(v, windows, vendor: str | None = None) -> DataFrame:
    """A10 for several windows at once: one row per (tag, start, end), without
    a vendor filter from the views' day partials if they are written, else from
    a single scan of the fact over the union of the windows. ``windows`` is a
    list of (tag, start, end)."""
    spark = v.spark
    days = _written_days(v) if vendor is None else None

    def ym(s, e):
        return year_month_between(s, e)

    cyc = (_tagged(v.payment_cycle, windows, ym).groupBy("tag")
           .agg(F.avg(F.col("avg_payment_cycle_time_days").cast("double")).alias("avg_days")))
    fp = (_tagged(v.full_payment, windows, ym).groupBy("tag")
          .agg(F.sum(F.col("full_paid_invoices").cast("bigint")).alias("fp_full_paid"),
               F.sum(F.col("total_cleared_invoices").cast("bigint")).alias("fp_total_cleared")))
    if days is not None:
        sides = [_daily_side(days, windows)]
    else:
        sides = [_fact_side(v, windows, vendor), _auto_side(v.status_history, windows)]
    # every window yields a row, also when it has no data (the tag list is
    # the caller's few windows: a fixed, tiny frame)
    tags = spark.createDataFrame([(t,) for t, _, _ in windows], "tag string")
    row = tags
    for side in (*sides, cyc, fp):
        row = row.join(F.broadcast(side), "tag", "left")
    a6 = F.col("avg_days")
    a7 = F.col("_fb_days").cast("double") / F.col("_fb_n")
    avg_days = F.when(F.coalesce(a6, F.lit(0.0)) == 0.0, F.coalesce(a7, F.lit(0.0))).otherwise(a6)
    zero = F.lit(0).cast("bigint")
    return row.select(
        "tag",
        F.coalesce(F.col("_spend"), F.lit(0)).cast("double").alias("total_spend"),
        *[F.coalesce(F.col(c), zero).alias(c)
          for c in ("active_pos", "total_pos", "pending_inv", "active_vendors")],
        avg_days.alias("avg_processing_days"),
        ratio("fp_full_paid", "fp_total_cleared", 100.0).alias("first_pass_rate"),
        ratio("auto_processed", "auto_total", 100.0).alias("auto_rate"))


def kpi_summary(v, start: _dt.date, end: _dt.date, vendor: str | None = None) -> DataFrame:
    """A10 the dashboard KPI row (flagship). ``v`` is a fixture ``Views``."""
    return kpi_multi(v, [("cur", start, end)], vendor).drop("tag")


def kpi_compare(v, start: _dt.date, end: _dt.date, vendor: str | None = None) -> DataFrame:
    """A11 current and prior-window KPIs side by side with deltas.

    Percent deltas (C7) for spend, POs, vendors and pending invoices; absolute
    deltas for days (lower is better) and first-pass points; the auto rate has
    no prior comparison and its delta is the rate itself."""
    p_start, p_end = prior_window(start, end)
    both = kpi_multi(v, [("cur", start, end), ("prev", p_start, p_end)], vendor)
    # two rows -> one: a global aggregate over the two-row frame
    j = both.agg(*[F.max(F.when(F.col("tag") == "cur", F.col(c))).alias(c) for c in KPI_COLUMNS],
                 *[F.max(F.when(F.col("tag") == "prev", F.col(c))).alias(f"prev_{c}")
                   for c in KPI_COLUMNS])
    # one expression for all percent deltas and one for all texts with a decimal
    pairs = (("spend", "total_spend"), ("active_pos", "active_pos"), ("total_pos", "total_pos"),
             ("vendors", "active_vendors"), ("pending", "pending_inv"))
    deltas = F.transform(F.array(*[F.struct(F.col(c).cast("double").alias("cur"),
                                            F.col(f"prev_{c}").cast("double").alias("prev")) for _, c in pairs]),
                         lambda x: pct_delta(x["cur"], x["prev"]))
    days_d = F.col("avg_processing_days") - F.col("prev_avg_processing_days")
    fp_d = F.col("first_pass_rate") - F.col("prev_first_pass_rate")
    texts = F.transform(F.array(days_d, fp_d, F.col("auto_rate")), lambda x: fixed_text(x, 1))
    j = j.withColumns({"_deltas": deltas, "_texts": texts})
    out = [F.col(c) for c in KPI_COLUMNS] + [F.col(f"prev_{c}") for c in KPI_COLUMNS]
    for i, (name, c) in enumerate(pairs):
        d = F.col("_deltas")[i]
        label = d["label"]
        if name == "vendors":
            label = F.when(F.col(f"prev_{c}") > 0, label).otherwise(F.lit("-"))
        out.append(label.alias(f"{name}_delta"))
        # lower is better for pending invoices
        out.append((~d["up"] if name == "pending" else d["up"]).alias(f"{name}_good"))
    text = F.col("_texts")
    out.append(F.concat(text[0], F.lit("d")).alias("days_delta"))
    out.append((days_d < 0).alias("days_good"))
    out.append(F.concat(text[1], F.lit("%")).alias("first_pass_delta"))
    out.append((fp_d > 0).alias("first_pass_good"))
    out.append(F.concat(F.lit("+"), text[2], F.lit("%")).alias("auto_delta"))
    return j.select(*out)
