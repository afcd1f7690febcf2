"""Every page builds; a few run."""

import pytest

from ledgerflow import pages, semantics as S

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def v(spark):
    return pages.open_views(spark, SF_SMALL, S.AS_OF)


def test_pages_build_and_run(v):
    built = {}
    built.update({f"dash.{k}": d for k, d in pages.dashboard(v).items()})
    built.update({f"dash_vendor.{k}": d for k, d in pages.dashboard(v, "QTD", "Supplier#000000001").items()})
    built.update({f"forecast.{k}": d for k, d in pages.forecast(v).items()})
    for name in ("Spending Overview", "Vendor Analysis", "Payment Performance", "Invoice Aging"):
        built.update({f"{name}.{k}": d for k, d in pages.quick_analysis(v, name).items()})
    intents = sorted({i for _, i in S.EXACT_ROUTES} | {i for _, i in S.KEYWORD_ROUTES} | {"custom"})
    for intent in intents:
        built.update({f"{intent}.{k}": d for k, d in pages.prebuilt_answer(v, intent).items()})
    built.update({f"inv.{k}": d for k, d in pages.invoices(v, status="DUE_NEXT_30").items()})
    number = v.invoice.agg({"invoice_number": "min"}).collect()[0][0]
    built.update({f"detail.{k}": d for k, d in pages.invoice_detail(v, number).items()})
    assert all(d.columns for d in built.values())
    assert built["dash.kpis"].count() == 1
    assert built["forecast.cash_flow"].count() >= 1
    assert built["detail.history"].count() >= 1
