"""Isolation forest (Liu, Ting, Zhou, ICDM 2008).

Trees are grown from a fixed number of rows each, so training is bounded however many
authors there are; scoring is a map over all authors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from palaver.operators.quantiles import exact_quantiles
from palaver.session import stage

TREES = 100
ROWS_PER_TREE = 256
# Rows kept per tree before ranking, as a multiple of what the tree needs.
_OVERSAMPLE = 4

_TREE_SCHEMA = (
    "tree int, sample_rows int, feature array<int>, threshold array<double>, "
    "left array<int>, right array<int>, path array<double>"
)


def _expected_path(rows: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``rows`` leaves."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (np.log(rows - 1.0) + np.euler_gamma) - 2.0 * (rows - 1.0) / rows


def _grow(rows: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One tree as parallel node lists; a leaf has feature -1 and its path length."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    tree: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "path": []}

    def add(part: np.ndarray, depth: int) -> int:
        node = len(tree["feature"])
        low, high = part.min(axis=0), part.max(axis=0)
        choices = np.flatnonzero(high > low)
        leaf = depth >= limit or len(part) <= 1 or len(choices) == 0
        for name, empty in zip(tree, (-1, 0.0, node, node, 0.0)):
            tree[name].append(empty)
        if leaf:
            tree["path"][node] = depth + _expected_path(len(part))
            return node
        feature = int(rng.choice(choices))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:
            threshold = float(low[feature])
        goes_left = part[:, feature] <= threshold
        tree["feature"][node], tree["threshold"][node] = feature, threshold
        tree["left"][node] = add(part[goes_left], depth + 1)
        tree["right"][node] = add(part[~goes_left], depth + 1)
        return node

    add(rows, 0)
    return tree


def _samples(
    scaled: DataFrame, columns: Sequence[str], share: float, rows: int, trees: int, seed: int
) -> DataFrame:
    """The ``rows`` authors with the smallest hash of (seed, tree, author), for every tree."""
    bound = int(share * 2.0**64 - 2.0**63) if share < 1 else None
    ticket = F.xxhash64(F.lit(seed), F.col("tree"), F.col("author_id"))
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))
    if bound is not None:
        numbers = F.filter(
            numbers, lambda t: F.xxhash64(F.lit(seed), t, F.col("author_id")) < F.lit(bound))
    drawn = scaled.select("author_id", *columns, F.explode(numbers).alias("tree"))
    order = Window.partitionBy("tree").orderBy("ticket", "author_id")
    return (
        drawn.withColumn("ticket", ticket)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= rows)
        .drop("ticket", "place")
    )


def fit_forest(
    scaled: DataFrame, columns: Sequence[str], seed: int = 42,
    trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE,
) -> list:
    """Grows the trees, one task group each, and returns them (at most 511 nodes a tree)."""
    names = list(columns)
    authors = scaled.count()
    if authors == 0:
        raise ValueError("a forest needs at least one author")
    rows = min(rows_per_tree, authors)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["tree"].iloc[0])
        matrix = pdf.sort_values("author_id")[names].to_numpy(dtype=float)
        tree = _grow(matrix, np.random.default_rng([seed, number]))
        return pd.DataFrame([{"tree": number, "sample_rows": len(pdf), **tree}])

    share = min(1.0, _OVERSAMPLE * rows / authors)
    while True:
        drawn = _samples(scaled, names, share, rows, trees, seed)
        grown = drawn.groupBy("tree").applyInPandas(grow, _TREE_SCHEMA).orderBy("tree").collect()
        if share == 1.0 or (len(grown) == trees and all(t["sample_rows"] == rows for t in grown)):
            return grown
        share = 1.0  # a tree drew too few rows: rank all of them


def score_forest(scaled: DataFrame, columns: Sequence[str], forest: list) -> DataFrame:
    """Adds ``forest_score`` in -1..0; lower is easier to isolate."""
    sizes = np.array([len(t["feature"]) for t in forest])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    shift = np.repeat(starts, sizes)
    feature = np.concatenate([t["feature"] for t in forest])
    nodes = {
        "feature": np.maximum(feature, 0),
        "threshold": np.concatenate([t["threshold"] for t in forest]),
        "left": np.concatenate([t["left"] for t in forest]) + shift,
        "right": np.concatenate([t["right"] for t in forest]) + shift,
        "path": np.concatenate([t["path"] for t in forest]),
    }
    sample_rows = forest[0]["sample_rows"]
    steps = int(np.ceil(np.log2(max(sample_rows, 2))))
    scale = _expected_path(sample_rows) or 1.0
    model = scaled.sparkSession.sparkContext.broadcast((nodes, starts))

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        parts, roots = model.value
        matrix = np.column_stack([v.to_numpy(dtype=float) for v in values])
        rows = np.arange(len(matrix))
        total = np.zeros(len(matrix))
        for root in roots:
            at = np.full(len(matrix), root)
            for _ in range(steps):  # a leaf leads to itself
                goes_left = matrix[rows, parts["feature"][at]] <= parts["threshold"][at]
                at = np.where(goes_left, parts["left"][at], parts["right"][at])
            total += parts["path"][at]
        return pd.Series(-np.power(2.0, -total / (len(roots) * scale)))

    return scaled.withColumn("forest_score", score(*[F.col(c) for c in columns]))


def anomaly_flag(value: Column) -> Column:
    return F.when(value < 0, -1).otherwise(1)


def anomaly_scores(
    scaled: DataFrame, columns: Sequence[str], contamination: float = 0.05, seed: int = 42,
    trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE,
) -> DataFrame:
    """``author_id``, ``anomaly_score`` (-1 or 1) and ``anomaly_score_val``.

    The value is the forest score minus its ``contamination`` quantile, so that share of
    authors is negative. ``trees`` and ``rows_per_tree`` are the method's published defaults.
    """
    forest = fit_forest(scaled, columns, seed, trees, rows_per_tree)
    scored = stage(
        score_forest(scaled, columns, forest).select("author_id", "forest_score"), "forest")
    offset = exact_quantiles(scored, ["forest_score"], [contamination])["forest_score", contamination]
    value = F.col("forest_score") - F.lit(offset)
    return scored.select(
        "author_id", anomaly_flag(value).alias("anomaly_score"), value.alias("anomaly_score_val"))
