"""Window / analytic operators W1-W8.

Scale rule: a window without ``partitionBy`` runs in one task, so the
unpartitioned ones here (W4, W5, W6 on a page) are only applied to
aggregated or top-k frames with a bounded row count. W2 ranks in (group,
salt) first; W8 numbers rows in two levels (``prefix_sums``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.dashboard import share_of_total, spend_forecast  # noqa: F401  (W1, W7)
from ledgerflow.session import written


def top_n_per_group(df: DataFrame, keys, order: list, n: int, salts: int = 16) -> DataFrame:
    """Top ``n`` rows per group in ``order`` without sending a hot group to one
    task: rows are first ranked within (group, salt) buckets, keeping at most
    ``n`` per bucket, then at most ``n * salts`` survivors per group are
    ranked again. The salt is a hash of the whole row, so a group holding a
    third of the data is spread over ``salts`` tasks in the first step. The
    salt hashes the row's input position (partition id, row id), which is
    cheap for wide rows and repeats exactly when a lost task is recomputed
    from the same input."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(salts))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    first = (df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(w1))
             .filter(F.col("_rn") <= n).drop("_rn", "_salt"))
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return first.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= n).drop("_rn")


def recent_n(messages: DataFrame, max_turns: int, session: str = "session_id",
             order=("turn_index", "ts")) -> DataFrame:
    """W2 newest ``max_turns * 2`` messages of each session, oldest first."""
    cols = [c for c in order if c in messages.columns]
    kept = top_n_per_group(messages, session, [F.col(c).desc() for c in cols], max_turns * 2)
    return kept.orderBy(session, *cols)


def latest_row(df: DataFrame, *keys: str) -> DataFrame:
    """W3 the row with the greatest key tuple (top-1)."""
    return df.orderBy(*[F.col(k).desc() for k in keys]).limit(1)


def period_change(monthly: DataFrame, order_col: str, value: str) -> DataFrame:
    """W4 MoM = newest row vs the next; QoQ = newest 3 rows vs the next 3
    (rows, not calendar months); 0 when there are too few rows or the base is
    0. ``monthly`` has one row per month (bounded)."""
    w = Window.orderBy(F.col(order_col).desc())
    # money is summed as an exact decimal so the result does not depend on
    # the order rows arrive in
    r = monthly.select(F.col(value).cast("decimal(38,2)").alias("v"),
                       F.row_number().over(w).alias("rn"))

    def s(lo, hi) -> Column:
        return F.sum(F.when(F.col("rn").between(lo, hi), F.col("v"))
                     .otherwise(F.lit(0).cast("decimal(38,2)"))).cast("double")

    agg = r.agg(F.count(F.lit(1)).alias("n"), s(1, 1).alias("m0"), s(2, 2).alias("m1"),
                s(1, 3).alias("q0"), s(4, 6).alias("q1"))
    mom = F.when((F.col("n") >= 2) & (F.col("m1") != 0),
                 (F.col("m0") - F.col("m1")) / F.col("m1") * 100.0).otherwise(F.lit(0.0))
    qoq = F.when((F.col("n") >= 6) & (F.col("q1") != 0),
                 (F.col("q0") - F.col("q1")) / F.col("q1") * 100.0).otherwise(F.lit(0.0))
    return agg.select(mom.alias("mom_pct"), qoq.alias("qoq_pct"))


def topn_share(ranked: DataFrame, order_value: str, value: str, n: int) -> DataFrame:
    """W5 share (%) of the first ``n`` rows (by ``order_value`` desc) in the
    total of ``value``; one row (total, share). Input is a top-k list."""
    w = Window.orderBy(F.col(order_value).desc())
    r = ranked.select(F.col(value).cast("decimal(38,2)").alias("v"),
                      F.row_number().over(w).alias("rn"))
    agg = r.agg(F.coalesce(F.sum("v").cast("double"), F.lit(0.0)).alias("total"),
                F.coalesce(F.sum(F.when(F.col("rn") <= n, F.col("v"))).cast("double"),
                           F.lit(0.0)).alias("top"))
    return agg.select("total", F.when(F.col("total") > 0, F.col("top") / F.col("total") * 100.0)
                      .otherwise(F.lit(0.0)).alias("share"))


def paginate(df: DataFrame, page: int, size: int, order: list) -> DataFrame:
    """W6 page ``page`` (0-based) of ``size`` rows in ``order``: a top-k of
    (page+1)*size rows then an offset. Deep pages grow that top-k; use
    ``page_after`` to go on from the last row shown, or a ``page_index``."""
    return df.orderBy(*order).offset(page * size).limit(size)


def page_after(df: DataFrame, size: int, keys: list[str], last: dict) -> DataFrame:
    """W6 the next ``size`` rows after the row ``last`` in ascending ``keys``
    (non-null, unique together): a filter that is pushed into the scan and a
    top-k of one page, however deep the page lies."""
    after = F.lit(False)
    for i, k in enumerate(keys):
        tied = reduce(lambda a, b: a & b, [F.col(x) == F.lit(last[x]) for x in keys[:i]], F.lit(True))
        after = after | (tied & (F.col(k) > F.lit(last[k])))
    return df.filter(F.col(keys[0]) >= F.lit(last[keys[0]])).filter(after).orderBy(*keys).limit(size)


def _placed(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """``df`` dealt into ``parts`` ranges of ``order``, sorted and written once
    (stable input for several passes), with ``_row``, which follows the order over
    all parts, and ``_part``. Rows that are equal in ``order`` are dealt by a hash
    of their place."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, F.col("_place")]
    rows = (df.withColumn("_place", F.xxhash64(F.monotonically_increasing_id()))
            .repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_place")
            .withColumn("_row", F.monotonically_increasing_id()))
    # monotonically_increasing_id: partition number in the upper bits, row in the lower 33
    return written(rows, "placed").withColumn("_part", F.shiftright("_row", 33))


@dataclass
class PageIndex:
    """W6 the rows of a query in order, written once, and the number of rows of
    each range. A page, however deep, is one range of ``_row``, which is pushed
    into the scan: files and row groups outside it are skipped by statistics."""

    rows: DataFrame
    counts: list[int]

    def page(self, page: int, size: int) -> DataFrame:
        """Page ``page`` (0-based) of ``size`` rows, in order."""
        lo, hi = self._row(page * size), self._row((page + 1) * size)
        return (self.rows.filter((F.col("_row") >= lo) & (F.col("_row") < hi)).orderBy("_row")
                .drop("_row", "_part"))

    def _row(self, number: int) -> int:
        for part, n in enumerate(self.counts):
            if number < n:
                return (part << 33) + number
            number -= n
        return len(self.counts) << 33


def page_index(df: DataFrame, order: list[Column], parts: int | None = None) -> PageIndex:
    """W6 an index of the pages of ``df`` in ``order`` (one written copy, one
    count a range). Runs its jobs at once; build it when many or deep pages are
    read, else use ``paginate``."""
    rows = _placed(df, order, parts)
    found = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}     # one row a range
    return PageIndex(rows, [found.get(p, 0) for p in range(max(found, default=-1) + 1)])


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], value: Column | None = None,
                parts: int | None = None, out: str = "_before") -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` (rows counted, if None) over the
    earlier rows of the same ``keys`` in ``order``. Null keys are a key.

    Skew-safe in two levels. Rows are dealt by range of (keys, order, a hash of
    their place) into ``parts`` parts (default: the shuffle partitions), so that
    the rows of one key, even of one instant, are cut by quantiles; each part is
    sorted and written once to the shared folder with its rows' numbers. From
    that stable table each (key, part) is summed up (one row each), the sums of
    a key's earlier parts are added, and a row's own part gives the rest: its
    number in the part, or, for a ``value``, a window over (key, part). The job
    that writes runs when this is called. The sampling of the ranges decides
    where parts are cut, never a sum."""
    table = _placed(df if value is None else df.withColumn("_value", value), [*[F.col(k).asc_nulls_first() for k in keys], *order], parts)
    names = [f"_key{i}" for i in range(len(keys))]
    total = F.count(F.lit(1)) if value is None else F.coalesce(F.sum("_value"), F.lit(0))
    sizes = (table.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, names)], F.col("_part").alias("_at"))
             .agg(total.alias("_sum"), F.min("_row").alias("_first")))
    earlier = Window.partitionBy(*names).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    if value is not None:
        own = (Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
        table = table.withColumn("_local", F.coalesce(F.sum("_value").over(own), F.lit(0)))
    same = table["_part"] == offsets["_at"]
    for k, c in zip(keys, names):
        same = same & table[k].eqNullSafe(offsets[c])
    local = F.col("_row") - F.col("_first") if value is None else F.col("_local")
    return table.join(offsets, same).withColumn(out, F.col("_off") + local).select(*df.columns, out)


def running_hit_count(writes: DataFrame, key: str = "query_hash", ts: str = "created_at",
                      tie: str | None = None, parts: int | None = None) -> DataFrame:
    """W8 per key, hits accumulated over re-writes: the n-th write (in
    ``ts``, ``tie`` order, nulls first) has n-1 hits. All columns are kept.
    Writes that are equal in ``ts`` and ``tie`` get different numbers in some
    fixed order. Skew-safe by ``prefix_sums``: a key with all its writes in one
    instant is still dealt over all parts. Runs a job when called."""
    order = [F.col(c).asc_nulls_first() for c in ([ts] + ([tie] if tie else []))]
    return prefix_sums(writes, [key], order, parts=parts, out="hit_count")
