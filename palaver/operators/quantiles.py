"""Exact quantiles by rank, at any size and with any number of equal values.

Equal values are one row with their count, combined before the shuffle. Values are range
partitioned and sorted, so that a running count over the partitions tells in which of them a rank
lies, and only those few are read again. No task sees more than one partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from palaver.session import stage

# What a partition's row numbers start from (monotonically_increasing_id).
_ROWS_OF_PARTITION = 1 << 33


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``metric``, ``value``, ``n``: every distinct value of every column, nulls left out."""
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return doubles.unpivot([], list(columns), "metric", "value").where("value IS NOT NULL").groupBy(
        "metric", "value").agg(F.count("*").alias("n"))


def _ordered(counts: DataFrame) -> DataFrame:
    """The counts in order, stored with the number of the partition that holds them."""
    keys = ["metric", "value"]
    return stage(
        counts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
            "part", F.floor(F.monotonically_increasing_id() / _ROWS_OF_PARTITION)), "values")


def values_at(spark: SparkSession, ordered: DataFrame, parts: list, ranks: Iterable[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """The value of every (column, rank). ``parts`` has metric, part, below, n: how many values lie
    below a partition, and in it."""
    wanted = [
        (p["metric"], p["part"], p["below"], rank)
        for metric, rank in sorted(set(ranks)) for p in parts
        if p["metric"] == metric and p["below"] <= rank < p["below"] + p["n"]]
    if not wanted:
        return {}
    asked = spark.createDataFrame(wanted, "metric string, part long, below long, rank long")
    places = asked.select("metric", "part", "below").distinct()
    # One row per rank asked for, so both small sides are bounded by the question.
    near = ordered.where(F.col("part").isin(sorted({w[1] for w in wanted}))).join(F.broadcast(places), ["metric", "part"]).withColumn(
        "upto", F.col("below") + F.expr("sum(n) OVER (PARTITION BY metric, part ORDER BY value)"))
    hits = near.drop("below").join(F.broadcast(asked), ["metric", "part"]).where("rank < upto AND rank >= upto - n")
    return {(r["metric"], r["rank"]): r["value"] for r in hits.select("metric", "rank", "value").collect()}


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float | None]:
    """Linear-interpolated quantiles of each column, nulls left out; None for no values.

    NaN counts as the largest value. The driver gets a row per column and partition, and one per
    rank asked for.
    """
    spark = df.sparkSession
    ordered = _ordered(value_counts(df, columns))
    runs = ordered.groupBy("metric", "part").agg(F.sum("n").alias("n"))
    parts = runs.withColumn("below", F.expr("sum(n) OVER (PARTITION BY metric ORDER BY part) - n")).collect()
    sizes = {c: sum(p["n"] for p in parts if p["metric"] == c) for c in columns}
    places = {(c, p): (sizes[c] - 1) * p for c in columns for p in probs if sizes[c]}
    found = values_at(spark, ordered, parts, [
        (c, rank) for (c, _), at in places.items() for rank in (math.floor(at), math.ceil(at))])

    def between(column: str, at: float) -> float:
        low, high, share = found[column, math.floor(at)], found[column, math.ceil(at)], at - math.floor(at)
        return low if share == 0 or low == high else low + share * (high - low)

    return {(c, p): between(c, places[c, p]) if (c, p) in places else None for c in columns for p in probs}
