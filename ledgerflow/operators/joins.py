"""Join operators J1-J9.

Dimension joins are left to Catalyst/AQE's size-checked strategy choice:
a dimension is broadcast only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold``; beyond it the join is a
sort-merge join on the key. Only tables with a fixed size bound (one-row
aggregates, region/nation-sized lookups) are broadcast explicitly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators.filters import invoice_key, vendor_match
from ledgerflow.sources.tables import small_side

VENDOR_COLS = ("vendor_id", "vendor_name")


def with_vendor(inv: DataFrame, ven: DataFrame, vendor: str | None = None,
                cols=VENDOR_COLS) -> DataFrame:
    """J1 fact LEFT JOIN vendor on vendor_id; J2 with a vendor filter, which
    makes it an inner join (R5)."""
    v = ven.select(*cols)
    if vendor is None:
        return inv.join(v, "vendor_id", "left")
    return inv.join(v.filter(vendor_match(vendor)), "vendor_id", "inner")


def selected_vendors(ven: DataFrame, vendor: str) -> DataFrame:
    """Vendor ids whose name matches the filter (case-insensitive), with the
    name as ``_sel_name``; usually one row, broadcast unless very many vendors
    share the name."""
    return small_side(ven.filter(vendor_match(vendor)).select("vendor_id",
                                                              F.col("vendor_name").alias("_sel_name")))


def names_of(per_vendor: DataFrame, ven: DataFrame, vendor: str | None = None) -> DataFrame:
    """Attach vendor names to a frame already aggregated per ``vendor_id``
    (aggregate first, then join: the dimension join sees one row per vendor
    instead of one per invoice, and a hot vendor cannot skew it). The vendor
    dimension is keyed by vendor_id. With ``vendor`` only matching rows stay."""
    return with_vendor(per_vendor, ven, vendor=vendor)


def with_company_plant(inv: DataFrame, company: DataFrame, plant: DataFrame) -> DataFrame:
    """J3 fact LEFT JOIN company LEFT JOIN plant. The caller's dimensions are
    broadcast while they are under Spark's size threshold."""
    return inv.join(company, "company_code", "left").join(plant, "plant_code", "left")


def vendor_profile(inv: DataFrame, ven: DataFrame, invoice_number) -> DataFrame:
    """J4 the vendor record of one invoice: DISTINCT, one row."""
    hit = inv.filter(F.col("invoice_number") == invoice_key(invoice_number)).select("vendor_id")
    prof = hit.join(ven, "vendor_id", "left").select(
        "vendor_id", "vendor_name", "vendor_name_2", "country_code", "city", "postal_code",
        "street").distinct()
    return prof.orderBy(F.col("vendor_id").asc_nulls_last(),
                        F.col("vendor_name").asc_nulls_last()).limit(1)


def cross_scalars(*one_row_dfs: DataFrame) -> DataFrame:
    """J5 CROSS JOIN of one-row aggregates (nested loop over single rows)."""
    return reduce(lambda a, b: a.crossJoin(b), one_row_dfs)


def full_outer_drivers(this_month: DataFrame, last_month: DataFrame,
                       key: str = "driver", value: str = "spend") -> DataFrame:
    """J6 this-month FULL OUTER JOIN last-month on the driver, both coalesced."""
    t = this_month.select(F.col(key).alias("_k"), F.col(value).alias("_t"))
    l = last_month.select(F.col(key).alias("_k2"), F.col(value).alias("_l"))
    j = t.join(l, t["_k"] == l["_k2"], "full")
    tm = F.coalesce(F.col("_t"), F.lit(0))
    lm = F.coalesce(F.col("_l"), F.lit(0))
    return j.select(F.coalesce("_k", "_k2").alias(key), tm.alias("this_month_spend"),
                    lm.alias("last_month_spend"), (tm - lm).alias("spend_change"))


def latest_pair(balance: DataFrame, aging: DataFrame) -> DataFrame:
    """J7 newest balance row LEFT JOIN newest aging row on (year, month)."""
    lb = balance.orderBy(F.col("year").desc(), F.col("month").desc()).limit(1)
    la = aging.orderBy(F.col("year").desc(), F.col("month").desc()).limit(1)
    return lb.join(la, ["year", "month"], "left")


def recent_messages(messages: DataFrame, sessions: DataFrame, user: str, cutoff) -> DataFrame:
    """J8 messages JOIN sessions for one user with ts >= cutoff."""
    s = sessions.filter(F.col("user_name") == F.lit(user)).select("session_id")
    m = messages.filter(F.col("ts") >= F.lit(cutoff))
    if "user_name" in m.columns:
        m = m.drop("user_name")
    return m.join(s, "session_id", "inner")


def sessions_with_counts(sessions: DataFrame, messages: DataFrame, user: str,
                         limit: int = 10) -> DataFrame:
    """J9 a user's newest ``limit`` sessions with their message counts; sessions
    without messages are dropped after the limit, as in the reference."""
    newest = (sessions.filter(F.col("user_name") == F.lit(user))
              .orderBy(F.col("last_updated").desc_nulls_last(), F.col("session_id"))
              .limit(limit))
    # ``newest`` has at most ``limit`` rows (a proven bound), so it is broadcast
    # to semi-join the message table before counting.
    wanted = F.broadcast(newest.select("session_id"))
    counts = (messages.join(wanted, "session_id", "left_semi")
              .groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count")))
    return newest.join(counts, "session_id", "inner").select(
        "session_id", "user_name", "created_at", "last_updated", "message_count")
