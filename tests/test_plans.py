"""Physical-plan properties that the scale design relies on."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from ledgerflow.plans.registry import load_all

from .conftest import SF_SMALL


def plan(spark, name, mode="formatted"):
    df = E.queries()[name](spark, SF_SMALL)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_kpi_date_range_is_pushed_into_the_scan(spark):
    p = plan(spark, "kpi_summary")
    assert "GreaterThanOrEqual(posting_date,1999-07-01)" in p
    assert "LessThanOrEqual(posting_date,2000-06-30)" in p


def test_kpi_compare_of_a_vendor_reads_the_fact_once(spark):
    p = plan(spark, "kpi_compare_vendor", "simple")
    fact = [ln for ln in p.splitlines() if "FileScan" in ln and "invoice_amount_local" in ln]
    ids = [ln for ln in p.splitlines() if "FileScan" in ln and "vendor_id" in ln and "purchase_order" not in ln]
    assert len(fact) == 1 and ids == []


@pytest.mark.parametrize("name", ["kpi_summary", "kpi_compare", "kpi_distinct_counts"])
def test_kpis_read_day_partials_and_not_the_fact(spark, name):
    p = plan(spark, name, "simple")
    scans = [ln for ln in p.splitlines() if "FileScan" in ln]
    assert sum("previous_date" in ln for ln in scans) == 1
    assert not any("invoice" in ln.split("PartitionFilters")[0] for ln in scans if "full_paid" not in ln
                   and "cleared_invoices" not in ln)


@pytest.mark.parametrize("name", ["mom_drivers", "invoice_search_all"])
def test_runtime_bounds_are_pushed_as_scalar_subqueries(spark, name):
    assert "GreaterThanOrEqual(posting_date,ScalarSubquery" in plan(spark, name)


def test_search_takes_its_bound_from_the_zone_index(spark):
    p = plan(spark, "invoice_search_all", "simple")
    scans = [ln for ln in p.splitlines() if "FileScan" in ln]
    index = [ln for ln in scans if "_b0" in ln]
    assert index                              # the written bits, not the fact, give the bound
    # every scan of the fact is bounded by the subquery or asks for undated rows
    fact = [ln for ln in scans if "invoice_number" in ln]
    assert fact and all("posting_date" in ln.split("PushedFilters")[1] for ln in fact)


@pytest.mark.parametrize("name", ["hub_vendor", "hub_po_line", "link_po_line_item", "sat_po_line"])
def test_vault_tables_shuffle_once(spark, name):
    p = plan(spark, name, "simple")
    shuffles = [ln for ln in p.splitlines() if "Exchange" in ln and "BroadcastExchange" not in ln]
    assert len(shuffles) == 1, p


def test_hub_reads_only_key_columns(spark):
    p = plan(spark, "hub_vendor")
    assert "ReadSchema: struct<s_suppkey:bigint>" in p
    assert "ReadSchema: struct<l_suppkey:bigint>" in p


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "PythonUDF", "MapInArrow")


def test_no_cartesian_products_no_python_and_nested_loops_only_in_j5(spark):
    joins, python = [], []
    for name in sorted(load_all()):
        p = plan(spark, name, "simple")
        if name != "kpi_parts_cross" and ("CartesianProduct" in p or "BroadcastNestedLoopJoin" in p):
            joins.append(name)
        if any(node in p for node in PYTHON_NODES):
            python.append(name)
    assert joins == []
    assert python == []
