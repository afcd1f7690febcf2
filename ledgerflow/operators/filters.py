"""Projection and filter operators F1-F18.

Window bounds (F2, F3) are computed on the driver from a handful of
dates; everything else is a Column predicate that Catalyst pushes into
the parquet scan where the column is a stored one.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow import semantics as S


def _lit_date(d) -> Column:
    return d if isinstance(d, Column) else F.lit(d).cast("date")


def date_range(df: DataFrame, start, end, col: str = "posting_date") -> DataFrame:
    """F1 BETWEEN, inclusive on both ends (R7)."""
    return df.filter(F.col(col).between(_lit_date(start), _lit_date(end)))


def range_preset(preset: str, as_of: _dt.date = S.AS_OF) -> tuple[_dt.date, _dt.date]:
    """F2 'Last 30 Days' / 'QTD' / 'YTD' as fixed day offsets back from as_of."""
    days = dict(S.RANGE_PRESETS).get(preset, S.RANGE_PRESET_DEFAULT_DAYS)
    return as_of - _dt.timedelta(days=days), as_of


def prior_window(start: _dt.date, end: _dt.date) -> tuple[_dt.date, _dt.date]:
    """F3 equal-length window ending the day before ``start``."""
    days = (end - start).days + 1
    prev_end = start - _dt.timedelta(days=1)
    return prev_end - _dt.timedelta(days=days - 1), prev_end


def vendor_match(vendor: str | None, col: str = "vendor_name") -> Column:
    """F4 predicate: case-insensitive exact match; None = all vendors."""
    if vendor is None:
        return F.lit(True)
    return F.upper(F.col(col)) == F.upper(F.lit(vendor))


def vendor_filter(df: DataFrame, vendor: str | None, col: str = "vendor_name") -> DataFrame:
    """F4 optional vendor filter (R5)."""
    return df if vendor is None else df.filter(vendor_match(vendor, col))


def status_is(*statuses: str, col: str = "invoice_status") -> Column:
    u = F.upper(F.col(col))
    return u == statuses[0] if len(statuses) == 1 else u.isin(*statuses)


def status_in(df: DataFrame, *statuses: str, col: str = "invoice_status") -> DataFrame:
    """F5 upper(status) IN (...); null status never matches (R2)."""
    return df.filter(status_is(*statuses, col=col))


def status_not_in(df: DataFrame, *statuses: str, col: str = "invoice_status") -> DataFrame:
    """F5 upper(status) NOT IN (...); null status is dropped as in SQL (R2)."""
    return df.filter(~status_is(*statuses, col=col))


def year_month_between(start: _dt.date, end: _dt.date, year: str = "year",
                       month: str = "month") -> Column:
    """F6 predicate on (year, month) pair columns: start's month to end's month."""
    lo, hi = start.year * 100 + start.month, end.year * 100 + end.month
    if lo > hi:
        return F.lit(False)
    # the plain year bound is pushable into the scan (and prunes year
    # partitions); the yyyymm range is exact
    return (F.col(year).between(start.year, end.year)
            & (F.col(year) * 100 + F.col(month)).between(lo, hi))


def year_month_filter(df: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """F6 months from start's month through end's month; empty range -> no rows."""
    return df.filter(year_month_between(start, end))


def due_within(as_of: _dt.date, days: int = S.DUE_SOON_DAYS, col: str = "due_date") -> Column:
    a = F.lit(as_of).cast("date")
    return F.col(col).between(a, F.date_add(a, days))


def due_window(df: DataFrame, as_of: _dt.date, days: int = S.DUE_SOON_DAYS) -> DataFrame:
    """F7 OPEN and as_of <= due_date <= as_of + days."""
    return df.filter(status_is(S.OPEN) & due_within(as_of, days))


def trailing_months(df: DataFrame, col: str, n: int, as_of: _dt.date) -> DataFrame:
    """F8 col >= add_months(as_of, -n); no upper bound (as in the reference)."""
    return df.filter(F.col(col) >= F.add_months(F.lit(as_of).cast("date"), -n))


def calendar_ytd(df: DataFrame, as_of: _dt.date, col: str = "posting_date") -> DataFrame:
    """F9 col >= first day of as_of's year."""
    return df.filter(F.col(col) >= F.lit(_dt.date(as_of.year, 1, 1)))


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    """F10 presence filters."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def invoice_key(invoice_number) -> Column:
    """Typed probe literal: the number is cleaned (what follows a decimal point
    is dropped, as C9 does) and cast, not the column, so that the filter stays
    pushable (the reference casts the column to text)."""
    if isinstance(invoice_number, (float, Decimal)):
        invoice_number = int(invoice_number)
    text = str(invoice_number).strip().partition(".")[0]
    return F.lit(text).try_cast("bigint")


INVOICE_DETAIL_ORDER = ("vendor_id", "invoice_amount", "invoice_date", "due_date", "po_number",
                        "invoice_status", "plant_code")


def invoice_lookup(inv: DataFrame, ven: DataFrame, invoice_number) -> DataFrame:
    """F11 one invoice's detail joined to its vendor, one row. The reference
    takes an arbitrary row when the number repeats; the order here makes
    the pick deterministic."""
    from ledgerflow.operators.joins import with_vendor
    hit = inv.filter(F.col("invoice_number") == invoice_key(invoice_number))
    j = with_vendor(hit, ven, cols=("vendor_id", "vendor_name", "vendor_name_2", "country_code",
                                    "city", "postal_code", "street"))
    out = j.select("invoice_number", F.col("posting_date").alias("invoice_date"),
                   F.col("invoice_amount_local").cast("double").alias("invoice_amount"),
                   F.col("purchase_order_reference").alias("po_number"),
                   F.col("po_amount").cast("double").alias("po_amount"), "due_date",
                   F.upper("invoice_status").alias("invoice_status"), "aging_days", "vendor_id",
                   "vendor_name", "vendor_name_2", "country_code", "city", "postal_code", "street",
                   "company_code", "plant_code", "currency")
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in INVOICE_DETAIL_ORDER]).limit(1)


def invoice_exists(inv: DataFrame, invoice_number) -> DataFrame:
    """F12 one-row existence probe: (invoice_number, found)."""
    hit = inv.filter(F.col("invoice_number") == invoice_key(invoice_number)).select(
        F.lit(1).alias("one")).limit(1)
    return (hit.groupBy().agg(F.count(F.lit(1)).alias("n"))
            .select(invoice_key(invoice_number).alias("invoice_number"),
                    (F.col("n") > 0).alias("found")))


NUMBER_SLOTS = 512


def _slot_words() -> list[Column]:
    """Invoice numbers hashed into NUMBER_SLOTS bits, eight longs."""
    h = F.pmod(F.xxhash64("invoice_number"), F.lit(NUMBER_SLOTS)).cast("int")
    return [F.bit_or(F.when(F.floor(h / 64) == i, F.expr(
        f"shiftleft(1L, cast(pmod(xxhash64(invoice_number), {NUMBER_SLOTS}) % 64 as int))"))
        .otherwise(F.lit(0).cast("bigint"))).alias(f"_b{i}") for i in range(NUMBER_SLOTS // 64)]


def date_index(inv: DataFrame) -> DataFrame:
    """F13 the zone index of the invoice view: per posting date and status the
    rows and the bits of their hashed invoice numbers. Bits of several statuses
    or dates combine by OR."""
    return (inv.filter(F.col("posting_date").isNotNull())
            .groupBy("posting_date", F.upper("invoice_status").alias("status"))
            .agg(F.count(F.lit(1)).alias("rows"), *_slot_words()))


def newest_rows(rows: DataFrame, limit: int, index: DataFrame | None = None) -> DataFrame:
    """The rows of the newest posting dates that surely hold ``limit`` distinct
    rows (all rows if none do).

    Per date, invoice numbers are hashed into ``NUMBER_SLOTS`` bits (eight
    longs, combined map-side): the bits set are a lower bound of its distinct
    rows. Dates are summed up newest first until the bound reaches ``limit``,
    usually after one or two dates. The oldest such date is a scalar subquery
    that Spark pushes into the parquet scan. Its input is one small row per
    date, however long the history is. With ``index`` (the ``date_index`` rows
    that belong to ``rows``) the bits come from there, and ``rows`` themselves
    are only read from the newest dates on."""
    if index is None:
        dates = rows.filter(F.col("posting_date").isNotNull()).groupBy("posting_date").agg(*_slot_words())
    else:
        dates = index.groupBy("posting_date").agg(
            *[F.bit_or(f"_b{i}").alias(f"_b{i}") for i in range(NUMBER_SLOTS // 64)])
    least = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"_b{i}")) for i in range(NUMBER_SLOTS // 64)])
    newest = Window.orderBy(F.col("posting_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = dates.select("posting_date", F.sum(least).over(newest).alias("_rows"))     # one row a date
    never = F.lit("0001-01-01").cast("date")
    bound = summed.filter(F.col("_rows") >= limit).agg(F.coalesce(F.max("posting_date"), never).alias("d")).scalar()
    # two branches so each predicate is pushable on its own (an OR is not);
    # both ask the same subquery, which runs once
    dated = rows.filter(F.col("posting_date") >= bound)
    undated = rows.filter(F.col("posting_date").isNull() & (bound == never))
    return dated.unionByName(undated)


def invoice_search(inv: DataFrame, ven: DataFrame, as_of: _dt.date, number=None,
                   vendor: str | None = None, status: str | None = None,
                   limit: int = S.SEARCH_ROWS, index: DataFrame | None = None) -> DataFrame:
    """F13 optional number AND vendor AND status (incl. the DUE_NEXT_30 pseudo
    status), DISTINCT rows, newest posting first, ``limit`` rows (the page
    size of the search screen). Ties on posting date are broken by every
    output column so the page is deterministic (R11). ``index`` is the view's
    ``date_index``: with it, a search by nothing or by a status reads the index
    and the newest dates' rows only."""
    from ledgerflow.operators.joins import with_vendor
    preds = []
    if number is not None:
        preds.append(F.col("invoice_number") == invoice_key(number))
    if status is not None:
        if status.upper() == S.PSEUDO_STATUS_DUE_NEXT_30:
            preds.append(status_is(S.OPEN) & due_within(as_of))
        else:
            preds.append(F.upper(F.col("invoice_status")) == F.upper(F.lit(status)))
    base = inv.filter(reduce(lambda a, b: a & b, preds)) if preds else inv
    if index is not None and status is not None:
        pseudo = status.upper() == S.PSEUDO_STATUS_DUE_NEXT_30       # asks for a due date, too
        index = None if pseudo else index.filter(F.col("status") == F.upper(F.lit(status)))
    j = with_vendor(base, ven, vendor=vendor)
    if number is None:
        # A left join to a keyed dimension keeps every fact row, so without a
        # vendor filter the bound can be taken from the fact itself.
        j = with_vendor(newest_rows(base, limit, index), ven) if vendor is None else newest_rows(j, limit)
    out = j.select("invoice_number", "vendor_name", "posting_date", "due_date",
                   F.col("invoice_amount_local").cast("double").alias("invoice_amount"),
                   F.col("purchase_order_reference").alias("po_number"),
                   F.upper(F.col("invoice_status")).alias("status")).distinct()
    return out.orderBy(F.col("posting_date").desc_nulls_last(), F.col("invoice_number").asc(),
                       F.col("vendor_name").asc_nulls_last(), F.col("due_date").asc_nulls_last(),
                       F.col("invoice_amount").asc_nulls_last(), F.col("po_number").asc_nulls_last(),
                       F.col("status").asc_nulls_last()).limit(limit)


def rename_select(df: DataFrame, mapping: dict[str, str] | None = None,
                  case: str | None = None) -> DataFrame:
    """F14 alias columns for a report; ``case`` 'lower'/'upper' for headers."""
    mapping = mapping or {}
    cols = [F.col(c).alias(mapping.get(c, c)) for c in df.columns]
    out = df.select(*cols)
    if case == "lower":
        out = out.toDF(*[c.lower() for c in out.columns])
    elif case == "upper":
        out = out.toDF(*[c.upper() for c in out.columns])
    return out


def tag_column(df: DataFrame, name: str, value) -> DataFrame:
    """F15 constant category column."""
    return df.withColumn(name, F.lit(value))


def split_by_tag(df: DataFrame, tag: str, values) -> dict[str, DataFrame]:
    """F16 per-category frames with the tag column dropped (lazy filters)."""
    return {v: df.filter(F.col(tag) == v).drop(tag) for v in values}


def min_share(df: DataFrame, col: str = "percentage", pct: float = S.MIN_SHARE_PCT) -> DataFrame:
    """F17 keep rows whose share is at least ``pct`` percent."""
    return df.filter(F.col(col) >= pct)


def first_non_empty(a: DataFrame, b: DataFrame) -> DataFrame:
    """F18 rows of ``a``, or of ``b`` when ``a`` has none.

    The probe stops at the first row of ``a``; the other frame is never read.
    It runs when the plan is built, as the choice decides what is planned."""
    return b.select(*a.columns) if a.isEmpty() else a
