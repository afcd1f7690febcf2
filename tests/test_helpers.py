"""Helpers that read names and schemas only (no rows), so they are not queries."""

import pytest

from ledgerflow.operators import vault as V
from ledgerflow.operators.setops import column_coverage_diff
from ledgerflow.sources import io
from ledgerflow.sources.bronze import BRONZE_SCHEMA, BRONZE_TABLES, NAME_MAP, fixture_model
from ledgerflow.sources.tables import RAW_TABLES, scan_view

from .conftest import SF_SMALL


def raw(spark):
    return {t: scan_view(spark, SF_SMALL, t) for t in BRONZE_TABLES}


def test_list_sources(spark, tmp_path):
    assert {r.table for r in io.list_sources(spark, SF_SMALL).collect()} == set(RAW_TABLES)
    with pytest.raises(ValueError):
        io.list_sources(spark, str(tmp_path))


def test_collect_schema(spark):
    got = {(r.table, r.column, r.position) for r in io.collect_schema(raw(spark)).collect()}
    assert got == {(t, c, i + 1) for t, cols in BRONZE_SCHEMA.items() for i, (c, _) in enumerate(cols)}


def test_translate_columns(spark):
    rows = V.translate_columns(io.collect_schema(raw(spark)), NAME_MAP).collect()
    by = {(r.table, r.column): (r.business_name, r.missing) for r in rows}
    assert by["supplier", "s_suppkey"] == ("VENDOR_ID", False)
    assert by["supplier", "s_acctbal"] == ("S_ACCTBAL", True)
    assert len(rows) == sum(len(c) for c in BRONZE_SCHEMA.values())


def test_column_coverage(spark):
    src = io.scan_bronze(spark, SF_SMALL, BRONZE_TABLES, NAME_MAP)
    model = fixture_model()
    need = spark.createDataFrame([(t, c) for t, cols in io.schema_map(src).items() for c in cols],
                                 "table string, column string")
    have = spark.createDataFrame([(s.source.upper(), a) for s in model.satellites for a in s.attributes],
                                 "table string, column string")
    gaps = {(r.table, r.column) for r in column_coverage_diff(need, have).collect()}
    assert ("REGION", "R_NAME") in gaps and ("SUPPLIER", "VENDOR_NAME") not in gaps
    full = V.ensure_coverage(V.complete_hubs(V.validate_model(model, io.schema_map(src), NAME_MAP)), io.schema_map(src))
    assert V.coverage_gaps(full, io.schema_map(src)) == {}


def test_transcript_documents_in_parts(spark):
    msgs = spark.createDataFrame([("s", 2, "user", "b"), ("s", 1, "bot", "a"), ("t", 1, "user", None)],
                                 "session_id string, turn_index long, role string, content string")
    docs = {r.session_id: r.document for r in io.assemble_transcript(io.export_transcript(msgs)).collect()}
    assert docs["s"].index("**Assistant**\n\na") < docs["s"].index("**User**\n\nb")
    assert docs["t"].startswith("# Conversation\n")
    assert io.assemble_transcript(io.export_transcript(msgs), part_chars=1).count() == 5


def test_transcript_of_a_million_messages_beside_small_ones(spark):
    n = 1_000_000
    long = spark.range(n).selectExpr("'long' AS session_id", "id AS turn_index", "'user' AS role",
                                     "repeat(concat('m', id), 1 + int(id % 3)) AS content")
    small = spark.range(200).selectExpr("concat('s', id % 20) AS session_id", "id AS turn_index", "'bot' AS role",
                                        "concat('text ', id) AS content")
    blocks = io.export_transcript(long.unionByName(small))
    parts = io.assemble_transcript(blocks, part_chars=1 << 18)
    rows = parts.filter("session_id = 'long'").orderBy("part").toPandas()
    assert len(rows) > 80 and list(rows["part"]) == list(range(len(rows)))
    assert max(map(len, rows["document"])) < (1 << 18) + 100
    want = ["# Conversation\n"] + [f"**User**\n\n{f'm{i}' * (1 + i % 3)}\n\n---\n" for i in range(n)]
    assert "\n".join(rows["document"]) == "\n".join(want)
    assert parts.filter("session_id <> 'long'").count() == 20


def test_cash_flow_total_without_unpaid_invoices(spark):
    import datetime as dt

    from ledgerflow.operators.forecast import cash_flow_buckets

    schema = "invoice_status string, due_date date, invoice_amount_local decimal(18,2)"
    for rows in ([], [("Paid", dt.date(2024, 1, 1), None)]):
        got = cash_flow_buckets(spark.createDataFrame(rows, schema), dt.date(2024, 1, 1)).collect()
        assert [tuple(r) for r in got] == [("TOTAL_UNPAID", None, None, None, None)]
