"""Registry of named queries: name -> (Spark builder, DuckDB oracle SQL).

Query builders take ``(spark, sf_dir)`` and return a lazy DataFrame over
the tables in ``sf_dir``. The oracle SQL (optional) reads the same raw
tables; fixture views are inlined by ``oracle.with_views``.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerflow import semantics as S
from ledgerflow.operators.filters import prior_window, range_preset
from ledgerflow.plans.oracle import with_views
from ledgerflow.sources.fixtures import Views

# Query parameters shared by the registered queries (FIXTURES.md pins as_of).
AS_OF = S.AS_OF
START, END = range_preset("YTD", AS_OF)           # 1999-07-01 .. 2000-06-30
PREV_START, PREV_END = prior_window(START, END)
VENDOR = "Supplier#000000012"
INVOICE = 114865                                   # repeats 6 times at sf0.01 (6 vendors)


def dlit(d: _dt.date) -> str:
    return f"DATE '{d.isoformat()}'"


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    survey_id: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, survey_id: str, sql: str | None = None):
    def deco(fn: Callable[[Views], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir, AS_OF))

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Entry(name, build, with_views(sql) if sql else None, survey_id)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    """Import every query module (each registers itself) and return the registry."""
    import importlib
    for mod in QUERY_MODULES:
        importlib.import_module(f"ledgerflow.plans.{mod}")
    return REGISTRY


QUERY_MODULES = ("q_kpi", "q_dashboard", "q_forecast", "q_analysis", "q_invoices",
                 "q_vault", "q_state", "q_scalars", "q_sinks")
