"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def clip(x: Column, lower, upper) -> Column:
    """Clamp, leaving null as null (``greatest`` alone would skip it)."""
    lo = lower if isinstance(lower, Column) else F.lit(lower)
    hi = upper if isinstance(upper, Column) else F.lit(upper)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def finite(x: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def r6(x: Column) -> Column:
    return F.round(x, 6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for output; the nudge moves exact halves off the rounding edge."""
    return df.select(
        *[
            F.round(F.col(f.name) + 1e-9, digits).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema
        ]
    )


def pick_column(df: DataFrame, *names: str) -> str | None:
    """First of the names that exists in the table."""
    return next((n for n in names if n in df.columns), None)
