"""Bronze fixture: raw tables under technical names, the static
technical -> business name map (V13) and the vault model (V5-V7).

FIXED VALUES: the name map and model below are the fixture's
(FIXTURES.md); ``s_acctbal`` is deliberately unmapped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

BRONZE_TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")

# Raw column types as stored (metadata; used to pick a column's hash text form).
BRONZE_SCHEMA = {
    "region": (("r_regionkey", "int"), ("r_name", "string")),
    "nation": (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")),
    "supplier": (("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")),
    "customer": (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")),
    "part": (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")),
    "orders": (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")),
    "lineitem": (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")),
}

# FIXED VALUES: technical -> business column names.
NAME_MAP = {
    "s_suppkey": "VENDOR_ID", "s_name": "VENDOR_NAME", "s_nationkey": "COUNTRY_ID",
    "n_nationkey": "COUNTRY_ID", "n_name": "COUNTRY_NAME", "n_regionkey": "REGION_ID",
    "c_custkey": "CUSTOMER_ID", "c_name": "CUSTOMER_NAME", "c_nationkey": "COUNTRY_ID",
    "c_acctbal": "BALANCE", "c_mktsegment": "SEGMENT",
    "o_orderkey": "PO_NUMBER", "o_custkey": "CUSTOMER_ID", "o_orderstatus": "PO_STATUS",
    "o_totalprice": "PO_AMOUNT", "o_orderdate": "PO_DATE", "o_orderpriority": "PO_PRIORITY",
    "l_orderkey": "PO_NUMBER", "l_partkey": "MATERIAL_ID", "l_suppkey": "VENDOR_ID",
    "l_linenumber": "LINE_NUMBER", "l_quantity": "QUANTITY", "l_extendedprice": "AMOUNT",
    "l_discount": "DISCOUNT", "l_tax": "TAX", "l_returnflag": "RETURN_FLAG",
    "l_linestatus": "LINE_STATUS", "l_shipdate": "SHIP_DATE",
    "p_partkey": "MATERIAL_ID", "p_name": "MATERIAL_NAME", "p_brand": "BRAND",
    "p_type": "MATERIAL_TYPE", "p_size": "SIZE", "p_retailprice": "LIST_PRICE",
}


@dataclass
class Hub:
    name: str
    entity: str
    keys: list[str]
    sources: list[str]

    @property
    def hk(self) -> str:
        return f"{self.entity}_HK"


@dataclass
class LinkRef:
    hub: str
    columns: list[str]
    role: str | None = None


@dataclass
class Link:
    name: str
    entity: str
    refs: list[LinkRef]
    sources: list[str]

    @property
    def hk(self) -> str:
        return f"LINK_{self.entity}_HK"


@dataclass
class Satellite:
    name: str
    hub: str
    hub_keys: list[str]
    source: str
    attributes: list[str] = field(default_factory=list)


@dataclass
class VaultModel:
    hubs: list[Hub]
    links: list[Link]
    satellites: list[Satellite]

    def hub(self, name: str) -> Hub | None:
        return next((h for h in self.hubs if h.name == name), None)


def fixture_model() -> VaultModel:
    """FIXED VALUES: the fixture vault model (priority order of sources)."""
    hubs = [
        Hub("HUB_VENDOR", "VENDOR", ["VENDOR_ID"], ["supplier", "lineitem"]),
        Hub("HUB_MATERIAL", "MATERIAL", ["MATERIAL_ID"], ["part", "lineitem"]),
        Hub("HUB_PURCHASE_ORDER", "PURCHASE_ORDER", ["PO_NUMBER"], ["orders", "lineitem"]),
        Hub("HUB_CUSTOMER", "CUSTOMER", ["CUSTOMER_ID"], ["customer", "orders"]),
        Hub("HUB_PO_LINE", "PO_LINE", ["PO_NUMBER", "LINE_NUMBER"], ["lineitem"]),
    ]
    links = [
        Link("LINK_PO_CUSTOMER", "PO_CUSTOMER",
             [LinkRef("HUB_PURCHASE_ORDER", ["PO_NUMBER"]), LinkRef("HUB_CUSTOMER", ["CUSTOMER_ID"])],
             ["orders"]),
        Link("LINK_PO_LINE_ITEM", "PO_LINE_ITEM",
             [LinkRef("HUB_PURCHASE_ORDER", ["PO_NUMBER"]), LinkRef("HUB_VENDOR", ["VENDOR_ID"]),
              LinkRef("HUB_MATERIAL", ["MATERIAL_ID"])],
             ["lineitem"]),
    ]
    sats = [
        Satellite("SAT_VENDOR", "HUB_VENDOR", ["VENDOR_ID"], "supplier",
                  ["VENDOR_NAME", "COUNTRY_ID", "S_ACCTBAL"]),
        Satellite("SAT_MATERIAL", "HUB_MATERIAL", ["MATERIAL_ID"], "part",
                  ["MATERIAL_NAME", "BRAND", "MATERIAL_TYPE", "SIZE", "LIST_PRICE"]),
        Satellite("SAT_PURCHASE_ORDER", "HUB_PURCHASE_ORDER", ["PO_NUMBER"], "orders",
                  ["CUSTOMER_ID", "PO_STATUS", "PO_AMOUNT", "PO_DATE", "PO_PRIORITY"]),
        Satellite("SAT_CUSTOMER", "HUB_CUSTOMER", ["CUSTOMER_ID"], "customer",
                  ["CUSTOMER_NAME", "COUNTRY_ID", "BALANCE", "SEGMENT"]),
        Satellite("SAT_PO_LINE", "HUB_PO_LINE", ["PO_NUMBER", "LINE_NUMBER"], "lineitem",
                  ["MATERIAL_ID", "VENDOR_ID", "QUANTITY", "AMOUNT", "DISCOUNT", "TAX",
                   "RETURN_FLAG", "LINE_STATUS", "SHIP_DATE"]),
    ]
    return VaultModel(hubs, links, sats)


def business_names(table: str, mapping: dict[str, str] = NAME_MAP) -> list[str]:
    """Business column names of a bronze table after V1/V2 (metadata only)."""
    from ledgerflow.operators.vault import rename_plan
    return rename_plan([c for c, _ in BRONZE_SCHEMA[table]], mapping)


def business_types(table: str, mapping: dict[str, str] = NAME_MAP) -> dict[str, str]:
    names = business_names(table, mapping)
    return {n: t for n, (_, t) in zip(names, BRONZE_SCHEMA[table])}
