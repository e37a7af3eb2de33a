"""Number formatting for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_FLOATS = (T.DoubleType, T.FloatType)


def fixed3(value: Column) -> Column:
    """Three decimals; empty text for null."""
    return F.when(value.isNotNull(), F.format_string("%.3f", value.cast("double"))).otherwise("")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def round_numbers(df: DataFrame, digits: int = 3) -> DataFrame:
    """Round every floating-point column half to even; integers stay as they are."""
    return df.select(*[
        F.bround(f.name, digits).alias(f.name) if isinstance(f.dataType, _FLOATS) else F.col(f.name)
        for f in df.schema.fields
    ])
