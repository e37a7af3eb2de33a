"""Reports over scored authors, and their display form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from palaver.functions.formatting import fixed3, numeric_columns
from palaver.operators.quantiles import exact_quantiles
from palaver.schemas import FEATURES

_QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}

SEGMENT_REPORT = T.StructType(
    [T.StructField("segment", T.IntegerType())]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
    + [T.StructField("count", T.LongType())]
)


def segment_report(scored: DataFrame) -> DataFrame:
    """Mean of every feature (nulls skipped) and number of authors per segment."""
    return scored.groupBy("segment").agg(
        *[F.avg(c).alias(c) for c in FEATURES], F.count("*").alias("count"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of every column, nulls left out."""
    chosen = df.select(*columns)
    quartiles = exact_quantiles(chosen, columns, list(_QUARTILES.values()))
    ranks = df.sparkSession.createDataFrame(
        [(c, *[quartiles[c, p] for p in _QUARTILES.values()]) for c in columns],
        T.StructType([T.StructField("metric", T.StringType())]
                     + [T.StructField(q, T.DoubleType()) for q in _QUARTILES]),
    )
    values = chosen.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "metric", "value")
    moments = values.groupBy("metric").agg(
        F.count("value").cast("double").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return ranks.join(moments, "metric").select(
        "metric", "count", "mean", "std", "min", *[F.col(f"`{q}`") for q in _QUARTILES], "max")


def anomaly_report(
    scored: DataFrame, columns: Sequence[str] = (*FEATURES, "anomaly_score_val")
) -> DataFrame:
    """``describe`` of every column over the anomalies."""
    return describe(scored.where("anomaly_score = -1"), columns)


def report_display(report: DataFrame) -> DataFrame:
    """Every cell as text: numbers with three decimals, null as empty text."""
    numbers = set(numeric_columns(report))
    return report.select(*[
        (fixed3(F.col(f"`{c}`")) if c in numbers
         else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c)
        for c in report.columns
    ])


def report_widths(report: DataFrame) -> DataFrame:
    """Widest cell or header of every column of the display form."""
    shown = report_display(report)
    widest = shown.agg(*[
        F.greatest(F.max(F.length(F.col(f"`{c}`"))), F.lit(len(c))).alias(c) for c in shown.columns
    ])
    return widest.unpivot([], widest.columns, "column_name", "width")
