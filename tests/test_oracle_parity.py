"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

import pytest

from .conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from compare import duck_con, rows_of, type_diffs  # noqa: E402

from ledgerflow.plans.registry import load_all  # noqa: E402

NAMES = sorted(n for n, e in load_all().items() if e.sql)


@pytest.fixture(scope="module")
def duck():
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert type_diffs(df.dtypes, duck, E.oracle_sql()[name]) == []
    sdf = df.toPandas()
    ddf = duck.execute(E.oracle_sql()[name]).df()
    sc, sr = rows_of(sdf)
    dc, dr = rows_of(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "total_spend"
    assert df.count() == 1


def test_rows_only_queries_run(spark):
    for name in sorted(set(load_all()) - set(NAMES)):
        assert E.queries()[name](spark, SF_SMALL).count() >= 0
