"""Registered queries: raw vault over the TPC-H-style bronze tables
(V1-V14, U4, U6, C20, S1, S3)."""

from __future__ import annotations

import datetime as _dt
import uuid

from ledgerflow.operators import vault as V
from ledgerflow.operators.setops import union_missing_cols
from ledgerflow.plans.registry import register
from ledgerflow.sources import io
from ledgerflow.sources.bronze import (BRONZE_SCHEMA, BRONZE_TABLES, NAME_MAP, Hub, VaultModel, business_names,
                                       fixture_model)

LOAD_TS = _dt.datetime(2024, 1, 31, 0, 0, 0)
LOAD_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def _sources(v):
    return io.scan_bronze(v.spark, v.root, BRONZE_TABLES, NAME_MAP)


# -- oracle SQL built from the same metadata ------------------------------------------
def _pre_sql(table: str, cols: list[str]) -> str:
    """The full values as text; the fixture's keys are all integers."""
    return "concat_ws('||', " + ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in cols) + ")"


def _bronze_cte(tables) -> str:
    parts = []
    for t in tables:
        names = business_names(t)
        sel = ", ".join(f"{raw} AS {biz}" for (raw, _), biz in zip(BRONZE_SCHEMA[t], names))
        parts.append(f"b_{t} AS (SELECT {sel} FROM {t})")
    return ",\n".join(parts)


def hub_sql(hub) -> str:
    keys = ", ".join(hub.keys)
    branches = "\nUNION ALL ".join(
        f"SELECT {_pre_sql(src, hub.keys)} AS _pre, {i} AS _prio, '{src}' AS RECORD_SOURCE, {keys} FROM b_{src}"
        for i, src in enumerate(hub.sources))
    order = ", ".join(f"{k} NULLS FIRST" for k in hub.keys)
    return f"""
WITH {_bronze_cte(hub.sources)},
u AS ({branches}),
r AS (SELECT *, row_number() OVER (PARTITION BY _pre ORDER BY _prio, {order}, RECORD_SOURCE) AS rn FROM u)
SELECT {keys}, sha256(_pre) AS {hub.hk}, concat_ws('|', {keys}) AS BUSINESS_KEY, {LOAD_SQL} AS LOAD_DTS,
       RECORD_SOURCE FROM r WHERE rn = 1"""


def sat_sql(sat, hub) -> str:
    names = business_names(sat.source)
    attrs = [c for c in names if c.upper() not in {k.upper() for k in sat.hub_keys}]
    return f"""
WITH {_bronze_cte([sat.source])}
SELECT DISTINCT sha256({_pre_sql(sat.source, sat.hub_keys)}) AS {hub.hk}, {", ".join(attrs)},
       sha256({_pre_sql(sat.source, attrs)}) AS HASH_DIFF, {LOAD_SQL} AS LOAD_DTS,
       '{sat.source}' AS RECORD_SOURCE, CAST(NULL AS TIMESTAMP) AS END_DTS
FROM b_{sat.source}"""


def link_sql(link, model) -> str:
    hk_names = V.link_hk_names(link, model)
    n = len(link.refs)
    branches = "\nUNION ALL ".join(
        "SELECT " + ", ".join(f"{_pre_sql(src, r.columns)} AS _t{i}" for i, r in enumerate(link.refs))
        + f", {p} AS _prio, '{src}' AS RECORD_SOURCE FROM b_{src}"
        for p, src in enumerate(link.sources))
    ts = ", ".join(f"_t{i}" for i in range(n))
    hks = ", ".join(f"sha256(_t{i})" for i in range(n))
    cols = ", ".join(f"sha256(_t{i}) AS {hk}" for i, hk in enumerate(hk_names))
    return f"""
WITH {_bronze_cte(link.sources)},
u AS ({branches}),
r AS (SELECT *, row_number() OVER (PARTITION BY {ts} ORDER BY _prio, RECORD_SOURCE) AS rn FROM u)
SELECT sha256(concat_ws('||', {hks})) AS {link.hk}, {cols}, {LOAD_SQL} AS LOAD_DTS, RECORD_SOURCE
FROM r WHERE rn = 1"""


MODEL = fixture_model()


def _register_vault_tables():
    for hub in MODEL.hubs:
        def make(h):
            def q(v):
                return V.build_hub(h, _sources(v), LOAD_TS, v.spark, MODEL)
            q.__doc__ = f"V5 {h.name}: distinct hashed business keys, source priority {h.sources}."
            return q
        register(hub.name.lower(), "V5+V4+C20+U4+U6", hub_sql(hub))(make(hub))
    for sat in MODEL.satellites:
        def make_s(s):
            def q(v):
                return V.build_satellite(s, MODEL.hub(s.hub), _sources(v), LOAD_TS, v.spark, MODEL)
            q.__doc__ = f"V6/V8 {s.name}: hub key, all attributes of {s.source}, HASH_DIFF."
            return q
        register(sat.name.lower(), "V6+V8+U5", sat_sql(sat, MODEL.hub(sat.hub)))(make_s(sat))
    for link in MODEL.links:
        def make_l(lk):
            def q(v):
                return V.build_link(lk, MODEL, _sources(v), LOAD_TS, v.spark)
            q.__doc__ = f"V7 {lk.name}: hub keys per reference and the link key."
            return q
        register(link.name.lower(), "V7+U6", link_sql(link, MODEL))(make_l(link))


_register_vault_tables()


def _counts_sql() -> str:
    parts = []
    for h in MODEL.hubs:
        parts.append(f"SELECT '{h.name}' AS \"table\", COUNT(*) AS rows FROM ({hub_sql(h)})")
    for s in MODEL.satellites:
        parts.append(f"SELECT '{s.name}' AS \"table\", COUNT(*) AS rows FROM ({sat_sql(s, MODEL.hub(s.hub))})")
    for lk in MODEL.links:
        parts.append(f"SELECT '{lk.name}' AS \"table\", COUNT(*) AS rows FROM ({link_sql(lk, MODEL)})")
    return "\nUNION ALL ".join(parts)


def _written_vault(v):
    return V.materialized_vault(v.spark, v.root, MODEL, _sources(v), LOAD_TS)


@register("vault_counts", "V12", _counts_sql())
def q_vault_counts(v):
    """V12 rows per vault table, read from the vault as written."""
    return V.vault_counts(_written_vault(v))


@register("vault_job", "V12+S2+S3", _counts_sql())
def q_vault_job(v):
    """V12 the whole job from the folder to a written vault, read back: rows per table of the model."""
    target = io.scratch_path(v.spark, "vault-job", uuid.uuid4().hex)
    return V.vault_counts(V.run_vault_job(v.spark, v.root, target, MODEL, NAME_MAP, LOAD_TS))


def _reconcile_sql() -> str:
    parts = []
    for s in MODEL.satellites:
        hub = MODEL.hub(s.hub)
        parts.append(f"""SELECT '{s.name}' AS child, '{hub.name}' AS hub, COUNT(*) AS orphans
FROM ({sat_sql(s, hub)}) c WHERE c.{hub.hk} NOT IN (SELECT {hub.hk} FROM ({hub_sql(hub)}))""")
    for lk in MODEL.links:
        for ref, hk in zip(lk.refs, V.link_hk_names(lk, MODEL)):
            hub = MODEL.hub(ref.hub)
            parts.append(f"""SELECT '{lk.name}' AS child, '{hub.name}' AS hub, COUNT(*) AS orphans
FROM ({link_sql(lk, MODEL)}) c WHERE c.{hk} NOT IN (SELECT {hub.hk} FROM ({hub_sql(hub)}))""")
    return "\nUNION ALL ".join(parts)


@register("vault_reconcile", "V14", _reconcile_sql())
def q_vault_reconcile(v):
    """V14 satellite / link keys missing from their hub (expected: none),
    checked on the written vault, in parts of bounded size: only the hash-key
    columns are read. Runs its jobs when built."""
    return v.spark.createDataFrame(V.reconcile_in_parts(_written_vault(v), MODEL),
                                   "child string, hub string, orphans bigint")


def _owing_sql(keys: str) -> str:
    return (f"SELECT COUNT(*) FROM ({keys}) k LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) s "
            "ON s.s_suppkey = k.id WHERE s.s_suppkey IS NULL")


@register("vault_reconcile_orphans", "V14", f"""
SELECT 'SAT_VENDOR' AS child, 'HUB_VENDOR' AS hub, ({_owing_sql("SELECT DISTINCT s_suppkey AS id, s_name, s_nationkey, s_acctbal FROM supplier")}) AS orphans
UNION ALL SELECT 'LINK_PO_LINE_ITEM', 'HUB_VENDOR',
  ({_owing_sql("SELECT DISTINCT l_suppkey AS id, l_orderkey, l_partkey FROM lineitem")})""")
def q_vault_reconcile_orphans(v):
    """V14 with real orphans: the vendor hub was loaded from suppliers in
    credit only, its satellite and link from everything."""
    s = _sources(v)
    hub = Hub("HUB_VENDOR", "VENDOR", ["VENDOR_ID"], ["supplier"])
    sat, link = MODEL.satellites[0], MODEL.links[1]
    vault = {"HUB_VENDOR": V.build_hub(hub, {"supplier": s["supplier"].filter("S_ACCTBAL >= 0")}, LOAD_TS),
             sat.name: V.build_satellite(sat, hub, s, LOAD_TS),
             link.name: V.build_link(link, MODEL, s, LOAD_TS)}
    refs = [r for r in link.refs if r.hub == "HUB_VENDOR"]
    own = VaultModel([hub], [type(link)(link.name, link.entity, refs, link.sources)], [sat])
    return V.vault_reconcile(vault, own)


@register("bronze_part_renamed", "S1+S3+V1+V2", f"""
WITH {_bronze_cte(["part"])} SELECT * FROM b_part""")
def q_bronze_part(v):
    """S3 a bronze table read and renamed to business names."""
    return _sources(v)["part"]


@register("union_customer_vendor_keys", "U4", """
SELECT c_custkey AS CUSTOMER_ID, c_nationkey AS COUNTRY_ID, NULL::BIGINT AS VENDOR_ID FROM customer
UNION ALL SELECT NULL::BIGINT, s_nationkey, s_suppkey FROM supplier""")
def q_union_missing(v):
    """U4 union by name padding absent columns with nulls."""
    s = _sources(v)
    return union_missing_cols(s["customer"].select("CUSTOMER_ID", "COUNTRY_ID"),
                              s["supplier"].select("COUNTRY_ID", "VENDOR_ID"))
