"""Materialised views: written once, published atomically, reused."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerflow import pages
from ledgerflow import semantics as S
from ledgerflow.sources import fixtures as FX
from ledgerflow.sources.views import CatalogViews, conform, write_views

from .conftest import SF_SMALL


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_view_written_once_and_reused(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "posting_date")

    base = FX.view_base(spark, SF_SMALL, "probe")     # a key no other test uses
    a = FX.materialized_view(spark, base, "probe_view", build, None)
    FX._VIEWS.clear()                            # force a second lookup on disk
    b = FX.materialized_view(spark, base, "probe_view", build, None)
    assert calls == [1]
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect()) == [0, 1, 2, 3, 4]


def test_losing_publisher_leaves_no_temp_folder(spark):
    base = FX.view_base(spark, SF_SMALL, "race")
    FX.materialized_view(spark, base, "race_view", lambda: spark.range(3), None)
    # a second writer that finishes after the first one published
    assert FX.publish(spark, spark.range(7), base, "race_view") is False
    target = _local(f"{base}/race_view")
    assert os.path.exists(os.path.join(target, "_SUCCESS"))
    assert [n for n in os.listdir(_local(base)) if n.startswith(".race_view-")] == []
    assert not [n for n in os.listdir(target) if n.startswith(".")and not n.endswith(".crc")]
    assert spark.read.parquet(f"{base}/race_view").count() == 3     # the first view is kept


def test_a_changed_file_inside_a_partition_folder_gives_a_new_view(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).selectExpr("id", "id % 2 AS p").write.partitionBy("p").parquet(path)

    def view():
        base = FX.view_base(spark, str(tmp_path), "probe")
        return base, FX.materialized_view(spark, base, "v", lambda: spark.read.parquet(path), None)

    old, first = view()
    assert first.count() == 5
    spark.range(3).write.mode("append").parquet(f"{path}/p=1")
    new, second = view()
    assert second.count() == 8 and new != old
    assert FX.drop_superseded(spark, new) == [old.rsplit("/", 1)[1]]
    assert second.count() == 8


def test_pages_run_on_catalog_views(spark):
    own = FX.Views(spark, SF_SMALL, S.AS_OF)
    folder = f"{own.base}/catalog"
    write_views(own, folder)
    v = CatalogViews(spark, folder, S.AS_OF)
    a, b = pages.dashboard(v), pages.dashboard(own)
    assert a["kpis"].drop("avg_processing_days").count() == 1
    assert sorted(map(tuple, a["status"].collect())) == sorted(map(tuple, b["status"].collect()))
    assert sorted(map(tuple, pages.forecast(v)["cash_flow"].collect())) == sorted(
        map(tuple, pages.forecast(own)["cash_flow"].collect()))
    # no such view: the buckets are computed
    without = CatalogViews(spark, folder, S.AS_OF, {"cash_flow": "no_such_view"})
    assert pages.cash_flow(without).count() == pages.cash_flow(v).count()
    number = own.invoice.agg({"invoice_number": "min"}).first()[0]
    assert pages.invoice_detail(v, f"{number}.0")["summary"].count() == 1


def test_a_view_without_a_needed_column_is_refused(spark):
    with pytest.raises(ValueError):
        conform(spark.range(1), "id bigint, vendor_id string", "x")
    out = conform(spark.range(1).selectExpr("id AS ID"), "id int, city string", "x")
    assert out.dtypes == [("id", "int"), ("city", "string")]


def test_the_fact_is_moved_once(spark, monkeypatch):
    """Only the order join shuffles: neither the supplier join nor the write does."""
    plans = {}

    def publish(spark, df, base, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(spark, df, base, name)

    real, limit = FX.publish, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(FX, "publish", publish)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = FX.view_base(spark, SF_SMALL, "moved-once")
        own = FX.Views(spark, SF_SMALL, S.AS_OF, materialize=False)
        FX.materialized_view(spark, base, "invoice", own._build_invoice, "posting_date")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plans["invoice"].count("Exchange hashpartitioning") == 2
    assert "REBALANCE" not in plans["invoice"] and "rebalance" not in plans["invoice"].lower()


def test_a_small_side_is_marked_by_its_rows(spark):
    from ledgerflow.sources.tables import small_side

    def marked(n):
        return "broadcast" in small_side(spark.range(n), 10)._jdf.queryExecution().logical().toString()

    assert marked(0) and marked(10) and not marked(11)


def test_line_rows_are_narrow_and_keep_odd_values(spark):
    """Nulls, the ends of the number ranges, and prices beyond the amounts."""
    keys = "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_extendedprice double, l_returnflag string"
    low, high = -2**31, 2**31 - 1
    rows = [(i, line, 1, part, price, flag) for i, (line, part, price, flag) in enumerate(
        (line, part, price, flag) for line in (None, low, -1, 0, 7, high) for part in (None, -69, -1, 0, 69, 70, 2**62)
        for price, flag in ((1.005, "N"), (None, None), (1e300, "R"), (-0.5, "")))]
    lines = spark.createDataFrame(rows, keys)
    out = FX._narrow_lines(lines)
    assert out.columns == ["l_orderkey", "l_suppkey", "l_amount", "l_no_amount", "l_code"]
    line, days, settled = FX.line_parts(F.col("l_code"))
    got = {r.l_orderkey: r for r in out.withColumns({"line": line, "days": days, "settled": settled}).collect()}
    for key, ln, _, part, price, flag in rows:
        r = got[key]
        want = None if part is None else (part % 70 if part >= 0 else -(-part % 70))
        assert (r.line, r.days, r.settled) == (ln, want, None if flag is None else flag != "N"), rows[key]
        assert r.l_no_amount == (1e300 if price == 1e300 else None)
        assert (r.l_amount is None) == (price in (None, 1e300))


def test_a_price_beyond_the_amounts_fails_only_in_a_joined_line(spark, tmp_path):
    from pyspark.errors import ArithmeticException

    def tables(folder, order_of_the_large):
        spark.sql("SELECT 0L n_nationkey, 'A' n_name, 0L n_regionkey").write.parquet(f"{folder}/nation.parquet")
        spark.sql("SELECT 1L s_suppkey, 'S' s_name, 0L s_nationkey").write.parquet(f"{folder}/supplier.parquet")
        spark.sql("SELECT 1L o_orderkey, TIMESTAMP '2000-01-01' o_orderdate, 5D o_totalprice").write.parquet(
            f"{folder}/orders.parquet")
        spark.createDataFrame([(1, 3, 1, 5, 2.5, "R"), (order_of_the_large, 1, 1, 5, 1e12, "R")],
                              "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, "
                              "l_extendedprice double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
        return FX.Views(spark, str(folder), S.AS_OF, materialize=False).invoice

    row, = tables(tmp_path / "apart", 2).collect()
    assert (row.invoice_number, float(row.invoice_amount_local), row.invoice_status) == (13, 2.5, "PAID")
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        with pytest.raises(ArithmeticException):
            tables(tmp_path / "joined", 1).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
