"""Edge semantics on tiny inputs."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerflow.functions import scalars as C
from ledgerflow.operators import dashboard as D
from ledgerflow.operators import filters as FL
from ledgerflow.operators import forecast as FC
from ledgerflow.operators import kpi
from ledgerflow.operators.joins import with_vendor
from ledgerflow.operators.windows import period_change

AS_OF = dt.date(2000, 6, 30)
INV = ("invoice_number long, vendor_id string, posting_date date, due_date date, payment_date date, "
       "invoice_amount_local decimal(12,2), purchase_order_reference long, invoice_status string, "
       "aging_days int")


def _inv(spark, rows):
    from decimal import Decimal
    fixed = [tuple(Decimal(v) if i == 5 and v is not None else v for i, v in enumerate(r))
             + ((AS_OF - r[3]).days if r[3] else None,) for r in rows]
    return spark.createDataFrame(fixed, INV)


def test_null_status_excluded_from_spend_and_null_amount_is_zero(spark):
    d = dt.date(2000, 6, 1)
    inv = _inv(spark, [(1, "1", d, d, None, 10, 1, "open"), (2, "1", d, d, None, 5, 1, None),
                       (3, "1", d, d, None, 7, 1, "Cancelled"), (4, "1", d, d, None, None, 2, "PAID")])
    row = inv.agg(kpi.kpi_total_spend(inv)).collect()[0]
    assert row.total_spend == 10.0


def test_vendor_filter_turns_left_join_inner_and_is_case_insensitive(spark):
    d = dt.date(2000, 6, 1)
    inv = _inv(spark, [(1, "1", d, d, None, 10, 1, "OPEN"), (2, "9", d, d, None, 5, 1, "OPEN")])
    ven = spark.createDataFrame([("1", "Acme")], "vendor_id string, vendor_name string")
    assert with_vendor(inv, ven).count() == 2
    assert with_vendor(inv, ven, vendor="ACME").count() == 1
    assert with_vendor(inv, ven, vendor="acm").count() == 0


def test_cash_flow_bucket_edges(spark):
    days = [-1, 0, 7, 8, 14, 15, 30, 31, 60, 61, 90, 91]
    df = spark.createDataFrame([(d,) for d in days], "d int")
    got = [r.b for r in df.select(FC.cash_flow_bucket(F.col("d")).alias("b")).collect()]
    assert got == ["OVERDUE_NOW", "DUE_7_DAYS", "DUE_7_DAYS", "DUE_14_DAYS", "DUE_14_DAYS",
                   "DUE_30_DAYS", "DUE_30_DAYS", "DUE_60_DAYS", "DUE_60_DAYS", "DUE_90_DAYS",
                   "DUE_90_DAYS", "BEYOND_90_DAYS"]


def test_cash_flow_total_equals_sum_of_buckets_and_null_due_excluded(spark):
    rows = [(i, "1", AS_OF, AS_OF + dt.timedelta(days=k), None, 10 + i, 1, s)
            for i, (k, s) in enumerate([(-5, "OVERDUE"), (3, "open"), (40, "DUE"), (100, "OPEN"),
                                        (3, "PAID")])]
    rows.append((99, "1", AS_OF, None, None, 1, 1, "OPEN"))
    out = {r.forecast_bucket: r for r in FC.cash_flow_buckets(_inv(spark, rows), AS_OF).collect()}
    total = out.pop("TOTAL_UNPAID")
    assert total.invoice_count == sum(r.invoice_count for r in out.values()) == 4
    assert total.total_amount == sum(r.total_amount for r in out.values())
    assert total.earliest_due is None


def test_pct_delta_cases(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (100.0, 100.01), (110.0, 100.0), (90.0, 100.0)],
                               "cur double, prev double")
    got = [(r.d.label, r.d.up) for r in df.select(C.pct_delta("cur", "prev").alias("d")).collect()]
    assert got == [("-", True), ("+100%", True), ("0%", True), ("+10.0%", True), ("-10.0%", False)]


def test_abbr_currency(spark):
    df = spark.createDataFrame([(0.5,), (12.5,), (999.0,), (1500.0,), (-2_500_000.0,), (3e9,)], "v double")
    got = [r.s for r in df.select(C.abbr_currency("v").alias("s")).collect()]
    assert got == ["$0", "$12", "$999", "$1.5K", "-$2.5M", "$3.0B"]


def test_forecast_last_row_is_actual_times_1_1(spark):
    t = spark.createDataFrame([(dt.date(2000, 1, 1), 10.0), (dt.date(2000, 2, 1), 20.0),
                               (dt.date(2000, 3, 1), 40.0)], "month date, actual_spend double")
    got = [(r.month, r.forecast_spend) for r in D.spend_forecast(t).orderBy("month").collect()]
    assert got[0] == ("2000-01", 15.0) and got[1] == ("2000-02", 30.0)
    assert abs(got[2][1] - 44.0) < 1e-9


def test_period_change_needs_enough_rows(spark):
    one = spark.createDataFrame([(dt.date(2000, 1, 1), 10.0)], "month date, v double")
    r = period_change(one, "month", "v").collect()[0]
    assert (r.mom_pct, r.qoq_pct) == (0.0, 0.0)
    rows = [(dt.date(2000, m, 1), float(m)) for m in range(1, 7)]
    r = period_change(spark.createDataFrame(rows, "month date, v double"), "month", "v").collect()[0]
    assert abs(r.mom_pct - (6 - 5) / 5 * 100) < 1e-9
    assert abs(r.qoq_pct - ((6 + 5 + 4) - (3 + 2 + 1)) / 6 * 100) < 1e-9


def test_year_month_filter_and_presets():
    s, e = FL.range_preset("YTD", AS_OF)
    assert (s, e) == (dt.date(1999, 7, 1), AS_OF)
    assert FL.range_preset("QTD", AS_OF)[0] == AS_OF - dt.timedelta(days=120)
    assert FL.range_preset("anything", AS_OF)[0] == AS_OF - dt.timedelta(days=30)
    ps, pe = FL.prior_window(dt.date(2000, 1, 10), dt.date(2000, 1, 19))
    assert (ps, pe) == (dt.date(1999, 12, 31), dt.date(2000, 1, 9))


def test_first_non_empty_both_paths(spark):
    a = spark.createDataFrame([(1,)], "x int")
    empty = a.filter("x < 0")
    b = spark.createDataFrame([(7,), (8,)], "x int")
    assert sorted(r.x for r in FL.first_non_empty(a, b).collect()) == [1]
    assert sorted(r.x for r in FL.first_non_empty(empty, b).collect()) == [7, 8]


def test_needs_attention_single_scan_equals_union(spark):
    d = dt.date(2000, 6, 1)
    rows = [(1, "1", d, AS_OF - dt.timedelta(days=1), None, 1, 1, "overdue"),
            (2, "1", d, None, None, 2, 1, "Disputed"),
            (3, "1", d, AS_OF + dt.timedelta(days=30), None, 3, 1, "OPEN"),
            (4, "1", d, AS_OF + dt.timedelta(days=31), None, 4, 1, "OPEN"),
            (5, "1", d, AS_OF, None, 5, 1, "OVERDUE")]
    inv = _inv(spark, rows)
    ven = spark.createDataFrame([("1", "Acme")], "vendor_id string, vendor_name string")
    a = sorted(D.needs_attention(inv, ven, d, AS_OF, AS_OF).collect())
    b = sorted(D.needs_attention_union(inv, ven, d, AS_OF, AS_OF).select(*a[0].__fields__).collect())
    assert a == b
    assert sorted(r.ref_no for r in a) == [1, 2, 3]


def test_scalar_text_rules(spark):
    qs = ["Hello there", "What is the weather", "Show late payment trend", "thanks for the invoice",
          "Forecast cash outflow for the next 7 days", "Which invoices should we pay early?",
          "Spend went up", "What is the optimal payment timing strategy", "Spending Overview",
          "12 + 4 vendors"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    got = df.select(C.is_relevant("q").alias("r"), C.route_intent("q").alias("i")).collect()
    assert [r.r for r in got] == [False, False, True, False, True, True, True, True, True, False]
    assert [r.i for r in got] == ["static", "static", "late_payment_trend", "static", "cash_flow",
                                  "early_payment", "custom", "payment_timing", "spending_overview",
                                  "static"]


def test_repair_json_map_paths(spark):
    df = spark.createDataFrame([("```json\n{\"a\": \"1\", \"b\": \"2\",}\n```",),
                                ("noise \"a\": \"x\" and \"b\" : \"y\" {broken",), ("no json",)], "t string")
    got = [r.m for r in df.select(C.repair_json_map("t").alias("m")).collect()]
    assert got[0] == {"a": "1", "b": "2"}
    assert got[1] == {"a": "x", "b": "y"}
    assert got[2] is None


def test_split_sections(spark):
    df = spark.createDataFrame([("**Descriptive** Spend rose.\n**Prescriptive**: Pay early.",),
                                ("Just text",)], "t string")
    got = [(r.s.descriptive, r.s.prescriptive) for r in df.select(C.split_sections("t").alias("s")).collect()]
    assert got == [("Spend rose.", "Pay early."), ("Just text", "")]


def test_detail_aging_never_negative(spark):
    df = spark.createDataFrame([(dt.date(2000, 7, 5), 3), (None, 12), (None, None)], "due date, aging int")
    got = [r.a for r in df.select(C.detail_aging("due", "aging", F.lit(AS_OF)).alias("a")).collect()]
    assert got == [0, 12, 0]


def _search_brute(rows, limit):
    import pandas as pd
    df = pd.DataFrame(rows, columns=["invoice_number", "vendor_name", "posting_date", "due_date",
                                     "invoice_amount", "po_number", "status"]).drop_duplicates()
    df["_null_date"] = df["posting_date"].isna()
    df = df.sort_values(["_null_date", "posting_date", "invoice_number"], ascending=[True, False, True],
                        kind="mergesort")
    return df.head(limit)


def test_invoice_search_bound_is_exact(spark):
    from decimal import Decimal
    ven = spark.createDataFrame([("1", "Acme"), ("2", "Beta")], "vendor_id string, vendor_name string")
    days = [dt.date(2000, 1, d) for d in (1, 2, 3, 4, 5)]
    rows = []
    n = 0
    for d in days + [None]:
        for rep in range(3):                     # exact copies collapse in the DISTINCT
            for k in range(2):
                n += 1
                rows.append((100 + k + (days.index(d) * 10 if d else 90), "1" if k == 0 else "2", d, d,
                             None, Decimal("10.00"), 7, "OPEN"))
    inv = spark.createDataFrame([r + (0,) for r in rows], INV)
    for limit in (1, 3, 7, 11, 40):
        got = FL.invoice_search(inv, ven, AS_OF, limit=limit).collect()
        exp = _search_brute([(r[0], "Acme" if r[1] == "1" else "Beta", r[2], r[3], 10.0, 7, "OPEN")
                             for r in rows], limit)
        assert [(g.invoice_number, g.posting_date) for g in got] == \
            [(e.invoice_number, None if e.posting_date != e.posting_date or e.posting_date is None
              else e.posting_date) for e in exp.itertuples()]


def test_repair_json_map_repeated_key_keeps_last(spark):
    df = spark.createDataFrame([("junk \"a\": \"1\" \"b\": \"2\" \"a\": \"3\" {",)], "t string")
    assert df.select(C.repair_json_map("t").alias("m")).collect()[0].m == {"a": "3", "b": "2"}
