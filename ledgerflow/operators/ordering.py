"""Sort / limit / top-k operators T1-T7.

Presto puts nulls last for both ASC and DESC, Spark puts them first for
ASC, so every key states its null order. Top-k (orderBy + limit) plans
as TakeOrderedAndProject: each task keeps its k best rows and only k per
task reach the final merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_key(k) -> Column:
    """'col' ascending, '-col' descending; nulls last either way (T1)."""
    if isinstance(k, Column):
        return k
    if k.startswith("-"):
        return F.col(k[1:]).desc_nulls_last()
    return F.col(k).asc_nulls_last()


def order_multi(df: DataFrame, *keys) -> DataFrame:
    """T1 multi-key order."""
    return df.orderBy(*[sort_key(k) for k in keys])


def order_by_case(df: DataFrame, col: str, ranks, out: str = "sort_rank") -> DataFrame:
    """T2 custom rank from a CASE over ``ranks`` (unknown values last); the rank
    is kept as a column so an order-insensitive check still sees it."""
    m = F.create_map(*[x for i, v in enumerate(ranks) for x in (F.lit(v), F.lit(i))])
    return df.withColumn(out, F.coalesce(m[F.col(col)], F.lit(len(ranks)))).orderBy(out)


def order_by_abs(df: DataFrame, col: str, *tie) -> DataFrame:
    """T3 order by absolute value, largest first."""
    return df.orderBy(F.abs(F.col(col)).desc(), *[sort_key(t) for t in tie])


def top_k(df: DataFrame, keys, k: int) -> DataFrame:
    """T4 first k rows of an order (keys must end in a unique key, R11)."""
    return df.orderBy(*[sort_key(x) for x in keys]).limit(k)


def limit_1(df: DataFrame, keys) -> DataFrame:
    """T5 one-row probe in a deterministic order."""
    return top_k(df, keys, 1)


def head_n(df: DataFrame, keys, n: int) -> DataFrame:
    """T6 first n rows of a computed result."""
    return top_k(df, keys, n)


def tail_n(df: DataFrame, key: str, n: int = 6) -> DataFrame:
    """T7 last n rows of an ascending order: top-n descending, re-sorted."""
    return df.orderBy(F.col(key).desc_nulls_first()).limit(n).orderBy(F.col(key).asc_nulls_last())


def with_rank(df: DataFrame, keys, out: str = "rank") -> DataFrame:
    """Row position in ``keys`` order for a bounded (top-k) frame."""
    from pyspark.sql import Window
    return df.withColumn(out, F.row_number().over(Window.orderBy(*[sort_key(x) for x in keys])))
