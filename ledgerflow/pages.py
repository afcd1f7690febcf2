"""One function per screen of the source application, each returning named
lazy DataFrames built from the operators (little is executed here: views are
written once, and F18 probes for a first row).

    v = open_views(spark, "/data/p2p")
    page = dashboard(v, preset="YTD", vendor=None)
    page["kpis"].show()
"""

from __future__ import annotations

import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ledgerflow import semantics as S
from ledgerflow.operators import analysis as AN
from ledgerflow.operators import dashboard as D
from ledgerflow.operators import forecast as FC
from ledgerflow.operators import invoices as I
from ledgerflow.operators import kpi
from ledgerflow.operators.filters import first_non_empty, invoice_lookup, range_preset, split_by_tag
from ledgerflow.operators.joins import vendor_profile
from ledgerflow.operators.reshape import unpivot_trend
from ledgerflow.sources.fixtures import Views
from ledgerflow.sources.views import CatalogViews


def open_views(spark: SparkSession, root: str, as_of: _dt.date | None = None) -> Views:
    """The analytic views over a data directory (as_of defaults to today)."""
    return Views(spark, root, as_of or _dt.date.today())


def dashboard(v: Views, preset: str = "YTD", vendor: str | None = None) -> dict[str, DataFrame]:
    """KPI cards with deltas, needs-attention tabs and the three charts."""
    start, end = range_preset(preset, v.as_of)
    attention = D.needs_attention(v.invoice, v.vendor, start, end, v.as_of, vendor)
    trend = D.spend_forecast(D.spend_trend(v.invoice, end))
    out = {
        "kpis": kpi.kpi_compare(v, start, end, vendor),
        "attention_counts": D.needs_attention_counts(attention),
        "status": D.status_distribution(v.invoice, start, end),
        "top_vendors": D.top_vendors_spend(v.invoice, v.vendor, start, end, vendor),
        "trend": trend,
        "trend_long": unpivot_trend(trend),
        "vendors": D.vendor_list(v.invoice, v.vendor, start, end),
    }
    for tag, frame in split_by_tag(attention, "category",
                                   [S.ATTENTION_OVERDUE, S.ATTENTION_DISPUTED, S.ATTENTION_DUE]).items():
        out[f"attention_{tag.lower()}"] = frame
    return out


def cash_flow(v: Views | CatalogViews) -> DataFrame:
    """The precomputed cash-flow view where there is one with rows (F18), else
    the buckets computed from the fact."""
    computed = FC.cash_flow_buckets(v.invoice, v.as_of)
    try:
        given = v.cash_flow
    except (AnalysisException, ValueError):
        return computed
    return first_non_empty(given, computed)


def forecast(v: Views) -> dict[str, DataFrame]:
    """Cash-flow obligations by bucket and the GR/IR reconciliation tab."""
    buckets = cash_flow(v)
    return {
        "cash_flow": FC.cash_flow_ordered(buckets),
        "cash_flow_headline": FC.cash_flow_headline(buckets),
        "grir_position": FC.grir_position(v.grir_balance, v.grir_aging),
        "grir_trend": FC.grir_trend(v.grir_balance),
    }


def quick_analysis(v: Views, name: str) -> dict[str, DataFrame]:
    """'Spending Overview', 'Vendor Analysis', 'Payment Performance' or 'Invoice Aging'."""
    if name == "Spending Overview":
        monthly = AN.monthly_spend(v.invoice, v.as_of)
        vendors = AN.top_vendors_ytd(v.invoice, v.vendor, v.as_of)
        return {"metrics": AN.spending_headline(monthly, vendors), "monthly": monthly, "vendors": vendors}
    if name == "Vendor Analysis":
        vendors = AN.vendor_analysis(v.invoice, v.vendor, v.as_of)
        return {"metrics": AN.vendor_concentration(vendors), "vendors": vendors,
                "monthly": AN.active_vendors_monthly(v.invoice, v.as_of)}
    if name == "Payment Performance":
        perf = AN.payment_performance(v.invoice, v.as_of)
        return {"metrics": AN.payment_headline(perf), "payments": perf}
    if name == "Invoice Aging":
        aging = AN.invoice_aging(v.invoice, v.as_of)
        return {"metrics": AN.aging_headline(aging), "aging": aging}
    raise ValueError(f"unknown analysis {name!r}")


def prebuilt_answer(v: Views, intent: str) -> dict[str, DataFrame]:
    """The data behind each routed intent (C22) that has a prebuilt analysis."""
    quick = {"spending_overview": "Spending Overview", "vendor_analysis": "Vendor Analysis",
             "payment_performance": "Payment Performance", "invoice_aging": "Invoice Aging"}
    if intent in quick:
        return quick_analysis(v, quick[intent])
    builders = {
        "cash_flow": lambda: {"cash_flow": FC.cash_flow_ordered(cash_flow(v))},
        "early_payment": lambda: {"candidates": FC.early_payment(v.invoice, v.vendor, v.as_of)},
        "payment_timing": lambda: {"windows": FC.payment_timing(v.invoice, v.as_of)},
        "late_payment_trend": lambda: {"trend": FC.late_payment_trend(v.invoice, v.as_of)},
        "grir_hotspots": lambda: {"balances": FC.grir_hotspots(v.grir_balance)},
        "grir_root_causes": lambda: {"inputs": FC.grir_root_cause_inputs(v.grir_balance, v.grir_aging)},
        "grir_working_capital": lambda: {
            "months": FC.grir_working_capital(v.grir_balance, v.as_of),
            "totals": FC.grir_working_capital_totals(FC.grir_working_capital(v.grir_balance, v.as_of))},
        "grir_vendor_followup": lambda: {"vendors": FC.grir_vendor_followup(v.invoice, v.vendor, v.as_of)},
        "custom": lambda: {"drivers": AN.mom_drivers(v.invoice, v.vendor, v.as_of)},
    }
    if intent not in builders:
        raise ValueError(f"no prebuilt analysis for intent {intent!r}")
    return builders[intent]()


def invoices(v: Views, number=None, vendor: str | None = None,
             status: str | None = None) -> dict[str, DataFrame]:
    """Invoice search (number / vendor / status incl. DUE_NEXT_30)."""
    from ledgerflow.operators.filters import invoice_search
    return {"results": invoice_search(v.invoice, v.vendor, v.as_of, number, vendor, status,
                                     index=getattr(v, "invoice_dates", None)),
            "vendors": D.vendor_names_all(v.vendor)}


def invoice_detail(v: Views, number) -> dict[str, DataFrame]:
    """Summary, status history (with defaults), vendor and company of one invoice."""
    from pyspark.sql import functions as F

    from ledgerflow.operators.filters import invoice_key
    from ledgerflow.operators.joins import with_company_plant
    hit = v.invoice.filter(F.col("invoice_number") == invoice_key(number))
    history = I.history_default(hit, v.status_history.filter(
        F.col("invoice_number") == invoice_key(number)))
    company = (with_company_plant(hit, v.company, v.plant)
               .select("company_code", "company_name", "plant_code", "plant_name").distinct()
               .orderBy("company_code", "plant_code").limit(1))
    return {"summary": invoice_lookup(v.invoice, v.vendor, number),
            "history": history.orderBy("sequence_nbr", "effective_date"),
            "vendor": vendor_profile(v.invoice, v.vendor, number),
            "company": company}
