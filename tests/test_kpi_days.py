"""Day partials of the KPIs: any window adds up to the same values as the fact."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest

from ledgerflow.operators import kpi

INVOICE = ("invoice_number bigint, vendor_id string, posting_date date, payment_date date, "
           "invoice_amount_local decimal(12,2), purchase_order_reference bigint, invoice_status string")
DAY0 = dt.date(2020, 1, 1)


def _day(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


def _facts(seed, n):
    """Random facts: ids that come back on many dates, one order with a third
    of all rows, ids far apart, nulls in every column, repeated rows."""
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        day = r.choice([None] + list(range(12)))
        po = 7 if r.random() < 0.33 else r.choice([None, 1, 2, 3, 2**62, -5])
        rows.append((r.choice([None, 10, 11, 12, 13, 2**61]), r.choice([None, "a", "b", "b2", "gone"]), _day(day),
                     _day(r.choice([None, 20, 25])), r.choice([None, 0, 1, 250]), po,
                     r.choice([None, "Open", "OPEN", "paid", "CLEARED", "Cancelled", "rejected", "Overdue"])))
    return rows + rows[:3]


def _views(spark, rows):
    from decimal import Decimal
    rows = [(*x[:4], None if x[4] is None else Decimal(x[4]), *x[5:]) for x in rows]
    inv = spark.createDataFrame(rows, INVOICE)
    # two ids share a name, one id has none
    ven = spark.createDataFrame([("a", "A"), ("b", "B"), ("b2", "B"), ("n", None)], "vendor_id string, vendor_name string")
    hist = spark.createDataFrame([(x[2], x[6], "Auto Processed" if i % 3 else None) for i, x in enumerate(rows)],
                                 "posting_date date, status string, status_notes string")
    return inv, ven, hist


def _expected(rows, lo, hi):
    w = [x for x in rows if x[2] is not None and lo <= x[2] <= hi]
    st = [(x, (x[6] or "").upper()) for x in w]
    names = {"a": "A", "b": "B", "b2": "B"}
    days = [(x[3] - x[2]).days for x, s in st if s in ("PAID", "CLEARED") and x[3] is not None]
    return {
        "total_spend": float(sum(x[4] or 0 for x, s in st if s and s not in ("CANCELLED", "REJECTED"))),
        "active_pos": len({x[5] for x, s in st if s == "OPEN"} - {None}),
        "total_pos": len({x[5] for x in w} - {None}),
        "pending_inv": len({x[0] for x, s in st if s == "OPEN"} - {None}),
        "active_vendors": len({names.get(x[1]) for x in w} - {None}),
        "avg_processing_days": sum(days) / len(days) if days else 0.0,
    }


@pytest.mark.parametrize("seed,n", [(1, 120), (2, 40), (3, 0)])
def test_windows_add_up(spark, seed, n):
    rows = _facts(seed, n)
    inv, ven, hist = _views(spark, rows)
    cycle = spark.createDataFrame([], "year int, month int, avg_payment_cycle_time_days double")
    full = spark.createDataFrame([], "year int, month int, full_paid_invoices bigint, total_cleared_invoices bigint")
    days = kpi.day_partials(inv, ven, hist).cache()
    v = SimpleNamespace(spark=spark, materialize=True, kpi_days=days, payment_cycle=cycle, full_payment=full)
    plain = SimpleNamespace(spark=spark, invoice=inv, vendor=ven, status_history=hist, payment_cycle=cycle,
                            full_payment=full)
    windows = [(f"{a}-{b}", _day(a), _day(b)) for a, b in ((0, 11), (3, 3), (2, 7), (5, 20), (-9, 1), (40, 50))]
    got = {r["tag"]: r.asDict() for r in kpi.kpi_multi(v, windows).collect()}
    fact = {r["tag"]: r.asDict() for r in kpi.kpi_multi(plain, windows).collect()}
    assert got == fact
    for tag, lo, hi in windows:
        exp = _expected(rows, lo, hi)
        assert {k: got[tag][k] for k in exp} == pytest.approx(exp)
    one = kpi.distinct_counts(v, *windows[2][1:]).first().asDict()
    assert one == {k: got["2-7"][k] for k in one}


def test_rows_are_bounded_by_the_dates(spark):
    """200 ids on each of five dates and one id on all rows: one row a measure
    and date, however many ids or facts there are."""
    inv = spark.range(1000).selectExpr(
        "id AS invoice_number", "'a' AS vendor_id", "date_add(DATE'2020-01-01', cast(id % 5 AS int)) AS posting_date",
        "cast(null AS date) AS payment_date", "cast(1 AS decimal(12,2)) AS invoice_amount_local",
        "id * 1000003 AS purchase_order_reference", "'OPEN' AS invoice_status")
    _, ven, hist = _views(spark, [])
    n = kpi.day_partials(inv, ven, hist).groupBy("measure").count().collect()
    assert {r["measure"]: r["count"] for r in n} == dict.fromkeys(
        ("active_pos", "total_pos", "pending_inv", "active_vendors", "spend", "paid_days", "paid"), 5)
