"""Set operators U1-U8."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all_tagged(branches: dict, tag: str = "category") -> DataFrame:
    """U1 UNION ALL of branches, each tagged with its key."""
    return reduce(lambda a, b: a.unionByName(b),
                  [df.withColumn(tag, F.lit(k)) for k, df in branches.items()])


def union_total_row(buckets: DataFrame, key: str, total_label: str, sums: list[str],
                    nulls: dict[str, str] | None = None) -> DataFrame:
    """U2 a TOTAL row (sums of ``sums``, typed nulls elsewhere) UNION ALL the
    rows. The total is a one-row aggregate of the (small) bucket frame."""
    nulls = nulls or {}
    total = buckets.agg(*[F.sum(c).alias(c) for c in sums]).select(
        F.lit(total_label).alias(key), *sums, *[F.lit(None).cast(t).alias(c) for c, t in nulls.items()])
    return total.unionByName(buckets.select(key, *sums, *nulls.keys()))


def union_typed_null(frames: list[DataFrame], fill_types: dict[str, str]) -> DataFrame:
    """U3 union of branches padded with NULL columns cast to a type."""
    padded = []
    for df in frames:
        for c, t in fill_types.items():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast(t))
        padded.append(df)
    return reduce(lambda a, b: a.unionByName(b), padded)


def union_missing_cols(*dfs: DataFrame) -> DataFrame:
    """U4 union by name, padding absent columns with nulls."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_rows(df: DataFrame, *cols: str) -> DataFrame:
    """U5 row-wise DISTINCT (over ``cols`` when given)."""
    return (df.select(*cols) if cols else df).distinct()


def dedupe_by_key(df: DataFrame, key, priority: list[str]) -> DataFrame:
    """U6 one row per key: the row with the smallest ``priority`` tuple (then
    the remaining columns), deterministic unlike the reference's arbitrary
    survivor. Written as ``min(struct)`` so it aggregates partially before the
    shuffle: a hot key is reduced in every map task, never sorted in one."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in priority]
    packed = F.struct(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(priority)],
                      *[F.col(c) for c in rest])
    return (df.groupBy(*keys).agg(F.min(packed).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}") for c in rest]))


def append_if_absent(history: DataFrame, new_rows: DataFrame, keys: list[str],
                     probe: DataFrame | None = None) -> DataFrame:
    """U7 history UNION ALL the new rows that have no match on ``keys``.
    ``probe`` (default: the history) is what the new rows are checked
    against; pass a filtered history when the new rows' keys are known to
    share constant values, so the anti join never shuffles the whole table."""
    p = (history if probe is None else probe).select(*keys)
    return history.unionByName(new_rows.join(p, keys, "left_anti"))


def column_coverage_diff(required: DataFrame, covered: DataFrame,
                         keys=("table", "column")) -> DataFrame:
    """U8 (table, column) pairs required but not covered."""
    return required.select(*keys).distinct().join(covered.select(*keys), list(keys), "left_anti")
