"""Reshape operators P1-P5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerflow import semantics as S


def unpivot_trend(forecast: DataFrame) -> DataFrame:
    """P1 (month, actual_spend, forecast_spend) -> (month, type, spend) with
    ACTUAL / FORECAST labels."""
    long = forecast.unpivot(["month"], ["actual_spend", "forecast_spend"], "type", "spend")
    labels = F.create_map(*[F.lit(x) for pair in S.TREND_TYPE_LABELS for x in pair])
    return long.withColumn("type", labels[F.col("type")])


def unpivot_drivers(drivers: DataFrame) -> DataFrame:
    """P2 this / last month columns -> (driver, period, spend)."""
    return drivers.unpivot(["driver"], ["this_month_spend", "last_month_spend"], "period", "spend")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def unpivot_numeric(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """P3 first non-numeric column as the dimension, all numeric columns
    melted to (dim, variable, value). With ``max_rows`` (a chart's display
    limit, off by default) it yields no rows when the input has more, decided
    in the plan by a one-row count."""
    nums = numeric_columns(df)
    dims = [c for c in df.columns if c not in nums]
    if not nums or not dims:
        return df.sparkSession.createDataFrame([], "dimension string, variable string, value double")
    dim = dims[0]
    src = df.select(F.col(dim).cast("string").alias("dimension"),
                    *[F.col(c).cast("double").alias(c) for c in nums])
    long = src.unpivot(["dimension"], nums, "variable", "value")
    if max_rows is None:
        return long
    return long.filter(df.agg(F.count(F.lit(1))).scalar() <= max_rows)


def title_header(name: str) -> str:
    """'total_amount' -> 'Total Amount' (column metadata, driver side)."""
    return name.replace("_", " ").title()


def report_frame(df: DataFrame, labels: dict[str, str] | None = None,
                 max_rows: int | None = None, order: list | None = None) -> DataFrame:
    """P4 display frame: all rows, or with ``max_rows`` (a page cap, off by
    default) the first so many in ``order``, which it then needs; nulls as '—', numbers with thousands separators (floats 2 dp unless
    whole), headers titled or relabelled."""
    if max_rows is not None:
        if not order:
            raise ValueError("a capped report needs an order")
        df = df.orderBy(*order).limit(max_rows)
    labels = labels or {}
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        t = f.dataType.typeName()
        if t in ("double", "float") or t.startswith("decimal"):
            d = c.cast("double")
            txt = F.when(d == F.floor(d), F.format_number(d, 0)).otherwise(F.format_number(d, 2))
        elif isinstance(f.dataType, NumericType):
            txt = F.format_number(c.cast("double"), 0)
        else:
            txt = c.cast("string")
        out.append(F.coalesce(txt, F.lit("—")).alias(labels.get(f.name, title_header(f.name))))
    return df.select(*out)


def stringify_objects(df: DataFrame) -> DataFrame:
    """P5 non-numeric columns as text."""
    nums = set(numeric_columns(df))
    return df.select(*[F.col(c) if c in nums else F.col(c).cast("string").alias(c)
                       for c in df.columns])
