"""Standardising columns by their population mean and spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from palaver.session import one_row


def _moments(df: DataFrame, columns: Sequence[str]) -> Column:
    return one_row(df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    ))


def _with_z(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    """Z-scores from one row of moments; 0 where a column has no spread or no values.

    The row is attached once, as a scalar subquery, so the moments are computed once.
    """

    def z(name: str) -> Column:
        std = F.nullif(F.col(f"_moments.std_{name}"), F.lit(0.0))
        scaled = (F.col(name) - F.col(f"_moments.mean_{name}")) / std
        return F.when(std.isNull(), F.lit(0.0)).otherwise(scaled)

    return (
        df.withColumn("_moments", _moments(df, columns))
        .withColumns({f"{prefix}{c}": z(c) for c in columns})
        .drop("_moments")
    )


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``z_<column>`` for every column."""
    return _with_z(df, columns, "z_")


def scaled_features(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``author_id`` and the model matrix: nulls as 0, zero mean, unit population spread."""
    filled = features.select(
        "author_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
    return _with_z(filled, columns, "")
