"""S1 the source system's own analytic views, read from a catalog database or
a folder against declared schemas.

``CatalogViews`` has the properties that operators and pages take from
``fixtures.Views``, so ``pages.dashboard(CatalogViews(spark, "p2p"))`` runs on
real views as it does on the derived ones.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# View names of the source system.
VIEW_NAMES = {
    "invoice": "fact_all_sources_vw", "vendor": "dim_vendor_vw", "company": "dim_company_code_vw",
    "plant": "dim_plant_vw", "status_history": "invoice_status_history_vw",
    "payment_cycle": "payment_processing_cycle_time_vw", "full_payment": "full_payment_rate_vw",
    "grir_balance": "gr_ir_outstanding_balance_vw", "grir_aging": "gr_ir_aging_vw",
    "cash_flow": "cash_flow_forecast_vw",
}

# Columns that operators read, with the type each is cast to; those in
# OPTIONAL are null where a view lacks them.
SCHEMAS = {
    "invoice": "invoice_number bigint, vendor_id string, posting_date date, due_date date, payment_date date, "
               "invoice_amount_local decimal(18,2), purchase_order_reference bigint, po_amount decimal(18,2), "
               "plant_code string, company_code string, currency string, aging_days int, invoice_status string",
    "vendor": "vendor_id string, vendor_name string, vendor_name_2 string, country_code string, city string, "
              "postal_code string, street string",
    "company": "company_code string, company_name string, street string, city string, postal_code string",
    "plant": "plant_code string, plant_name string",
    "status_history": "invoice_number bigint, sequence_nbr int, status string, effective_date date, "
                      "status_notes string, posting_date date",
    "payment_cycle": "year int, month int, avg_payment_cycle_time_days double, cleared_invoices bigint",
    "full_payment": "year int, month int, full_paid_invoices bigint, total_cleared_invoices bigint, "
                    "full_payment_rate_pct double",
    "grir_balance": "year int, month int, invoice_count bigint, total_grir_blnc decimal(18,2)",
    "grir_aging": "year int, month int, pct_grir_over_60 double, cnt_grir_over_60 bigint",
    "cash_flow": "forecast_bucket string, invoice_count bigint, total_amount double, earliest_due date, "
                 "latest_due date",
}
OPTIONAL = {"plant_code", "company_code", "currency", "po_amount", "vendor_name_2", "country_code", "city",
            "postal_code", "street", "full_payment_rate_pct"}


def conform(df: DataFrame, schema: str, name: str) -> DataFrame:
    """``df`` with exactly the declared columns, matched without case and cast;
    a missing column that is not optional is an error."""
    spelled = {c.upper(): c for c in df.columns}
    out, missing = [], []
    for part in schema.split(", "):
        col, kind = part.split(" ", 1)
        if col.upper() in spelled:
            out.append(F.col(spelled[col.upper()]).cast(kind).alias(col))
        elif col in OPTIONAL:
            out.append(F.lit(None).cast(kind).alias(col))
        else:
            missing.append(col)
    if missing:
        raise ValueError(f"view {name} lacks {missing}")
    return df.select(*out)


class CatalogViews:
    """The analytic views of a catalog database, or of a folder that holds one
    Parquet table a view (``<name>`` or ``<name>.parquet``). Lazy: a view is
    opened when first used."""

    def __init__(self, spark: SparkSession, source: str, as_of: _dt.date | None = None,
                 names: dict[str, str] | None = None):
        self.spark, self.source = spark, source.rstrip("/")
        self.as_of = as_of or _dt.date.today()
        self.names = VIEW_NAMES | (names or {})
        self._opened: dict[str, DataFrame] = {}

    def _open(self, name: str) -> DataFrame:
        if "/" not in self.source and ":" not in self.source:
            return self.spark.table(f"{self.source}.{name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.source}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.source}/{name}" if fs.exists(path)
                                       else f"{self.source}/{name}.parquet")

    def __getattr__(self, attr: str) -> DataFrame:
        if attr.startswith("_") or attr not in SCHEMAS:
            raise AttributeError(attr)
        if attr not in self._opened:
            name = self.names[attr]
            self._opened[attr] = conform(self._open(name), SCHEMAS[attr], name)
        return self._opened[attr]


def write_views(views, folder: str, attrs=tuple(VIEW_NAMES)) -> None:
    """Write views under their source names to a folder, once."""
    from ledgerflow.sources.fixtures import materialized_view

    for attr in attrs:
        materialized_view(views.spark, folder, VIEW_NAMES[attr], lambda a=attr: getattr(views, a), None)
