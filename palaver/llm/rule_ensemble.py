"""A quality classifier made of rules.

Small boosted trees are grown on statistics of labelled texts. Every path from a tree's root to one
of its nodes is a rule, a conjunction of bounds on a few statistics. A logistic model with an L1
penalty weighs the rules and leaves most of them out. What is left is compiled into one Spark
expression over the statistics, so scoring is a projection without Python.

The model is fitted on the driver from statistics (never texts) of at most ``SAMPLE`` labelled rows,
chosen by a hash of their id; nothing else depends on the number of rows. Rows whose crc32(doc_id)
is divisible by 5 never take part.

Null texts count as empty ones, and an empty text has a score like any other: its statistics are 0.
An id with several labels has the least of them; null labels say nothing. Rows without an id have no
label and are not held out. Without labels every score is 0.5; with labels of one kind it is their
smoothed share. Repeated rows get equal scores. Only doc_id and text of the documents are read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palaver.llm.common import documents, words_of

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
#: One in so many ids is held out.
FOLDS = 5
#: Scores from here on are predicted to be good.
GOOD_FROM = 0.3

TREES, DEPTH, CUTS, LEAST_ROWS, STEP = 60, 3, 32, 8, 0.3
PENALTIES = tuple(0.03 / 2**i for i in range(9))
SEED = 7

SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"

#: Name -> SQL over text, words (array), lines (array) and what stands above in this list.
STATISTICS = {
    "n_chars": "double(length(text))",
    "n_words": "double(size(words))",
    "n_lines": "double(size(lines))",
    "word_length": "coalesce(try_divide(aggregate(words, 0L, (a, w) -> a + length(w)), size(words)), 0d)",
    "distinct_words": "coalesce(try_divide(size(array_distinct(words)), size(words)), 0d)",
    "doubled_words": "coalesce(try_divide(size(filter(words, (w, i) -> i > 0 AND w = get(words, i - 1))), size(words)), 0d)",
    "distinct_lines": "coalesce(try_divide(size(array_distinct(lines)), size(lines)), 0d)",
    "words_per_line": "coalesce(try_divide(size(words), size(lines)), 0d)",
    "symbols_per_word": f"coalesce(try_divide(length(text) - length(translate(text, '{SYMBOLS}', '')), size(words)), 0d)",
    "shouts_per_word": "coalesce(try_divide(length(text) - length(translate(text, '!?', '')), size(words)), 0d)",
    "stops_per_word": "coalesce(try_divide(length(text) - length(translate(text, '.,;:', '')), size(words)), 0d)",
    "digit_share": f"coalesce(try_divide(length(text) - length(translate(text, '{DIGITS}', '')), length(text)), 0d)",
    "upper_share": r"coalesce(try_divide(length(regexp_replace(text, '\\P{Lu}+', '')), length(text)), 0d)",
    "short_words": "coalesce(try_divide(size(filter(words, w -> length(w) <= 3)), size(words)), 0d)",
}


def statistics(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the documents and the STATISTICS of their texts."""
    named = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(columns)]
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(*named, text.alias("text")).withColumns({
        "words": words_of(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")})
    return parts.select(
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(columns)],
        *[F.expr(rule).cast("double").alias(name) for name, rule in STATISTICS.items()])


@dataclass(frozen=True)
class Rule:
    """True where every (statistic, above, value) holds: value < statistic or statistic <= value."""

    bounds: tuple[tuple[str, bool, float], ...]

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return np.all([table[s] > v if above else table[s] <= v for s, above, v in self.bounds], axis=0)

    def column(self) -> Column:
        tests = [F.col(s) > F.lit(v) if above else F.col(s) <= F.lit(v) for s, above, v in self.bounds]
        whole = tests[0]
        for test in tests[1:]:
            whole = whole & test
        return whole


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; ``score`` is the probability of label 1."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, table: dict[str, np.ndarray]) -> np.ndarray:
        rows = len(next(iter(table.values())))
        total = np.full(rows, self.intercept)
        for rule, weight in self.rules:
            total += weight * rule.holds(table)
        return 1 / (1 + np.exp(-total))

    def to_json(self) -> str:
        return json.dumps({"intercept": self.intercept, "rules": [[rule.bounds, weight] for rule, weight in self.rules]})

    @staticmethod
    def from_json(text: str) -> Ensemble:
        read = json.loads(text)
        return Ensemble(read["intercept"], tuple((Rule(tuple(map(tuple, b))), w) for b, w in read["rules"]))


def _tighten(bounds: Sequence[tuple[str, bool, float]]) -> tuple[tuple[str, bool, float], ...]:
    """One bound for each statistic and side."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, value in bounds:
        known = tight.get((name, above), value)
        tight[name, above] = max(known, value) if above else min(known, value)
    return tuple((name, above, value) for (name, above), value in sorted(tight.items()))


def _cuts(values: np.ndarray) -> np.ndarray:
    """Points between neighbouring values, at most CUTS, at even ranks."""
    distinct = np.unique(values)
    if len(distinct) > CUTS:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1), method="nearest"))
    return (distinct[1:] + distinct[:-1]) / 2


def grow_paths(table: dict[str, np.ndarray], label: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Rule]:
    """The paths of gradient-boosted trees, each grown on a random half of the rows."""
    names = list(table)
    cuts = [_cuts(table[n]) for n in names]
    bins = np.stack([np.searchsorted(c, table[n], side="left") for c, n in zip(cuts, names)])
    rng = np.random.default_rng(seed)
    margin = np.full(len(label), math.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    found: dict[tuple, Rule] = {}

    def best_cut(rows: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[float, int, int]:
        best = (1e-6, -1, 0)
        whole = slope[rows].sum() ** 2 / (curve[rows].sum() + 1)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            size = len(c) + 1
            n = np.cumsum(np.bincount(bins[f, rows], minlength=size))[:-1]
            g = np.cumsum(np.bincount(bins[f, rows], slope[rows], size))[:-1]
            h = np.cumsum(np.bincount(bins[f, rows], curve[rows], size))[:-1]
            gain = g**2 / (h + 1) + (slope[rows].sum() - g) ** 2 / (curve[rows].sum() - h + 1) - whole
            gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
        return best

    def split(rows: np.ndarray, everyone: np.ndarray, bounds: list, slope: np.ndarray, curve: np.ndarray) -> None:
        """``rows`` choose the cuts, the node's value moves ``everyone`` that falls into it."""
        if bounds:
            rule = Rule(_tighten(bounds))
            found.setdefault(rule.bounds, rule)
        gain, f, at = best_cut(rows, slope, curve) if len(bounds) < depth and len(rows) >= 2 * LEAST_ROWS else (0, -1, 0)
        if f < 0:
            margin[everyone] += STEP * slope[rows].sum() / (curve[rows].sum() + 1)
            return
        for above in (False, True):
            side = lambda r: r[(bins[f, r] > at) == above]
            split(side(rows), side(everyone), [*bounds, (names[f], above, float(cuts[f][at]))], slope, curve)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        half = np.flatnonzero(rng.random(len(label)) < 0.5)
        split(half, np.arange(len(label)), [], label - p, p * (1 - p))
    return list(found.values())


def lasso_logistic(holds: np.ndarray, label: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 400) -> np.ndarray:
    """Intercept and weights that minimise mean log loss + penalty * sum of absolute weights, by
    accelerated proximal steps; the intercept is free."""
    design = np.column_stack([np.ones(len(label)), holds])
    # The curvature of the log loss is at most a quarter of the design's.
    step = 4 * len(label) / max(np.linalg.norm(design, 2) ** 2, 1e-12)
    shrink = np.full(design.shape[1], step * penalty)
    shrink[0] = 0
    weights = np.zeros(design.shape[1]) if start is None else start.copy()
    ahead, pace = weights, 1.0
    for _ in range(rounds):
        slope = design.T @ (1 / (1 + np.exp(-design @ ahead)) - label) / len(label)
        moved = ahead - step * slope
        following = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0)
        faster = (1 + math.sqrt(1 + 4 * pace**2)) / 2
        ahead = following + (pace - 1) / faster * (following - weights)
        if np.abs(following - weights).max() < 1e-7:
            return following
        weights, pace = following, faster
    return weights


def _loss(weights: np.ndarray, holds: np.ndarray, label: np.ndarray) -> float:
    margin = weights[0] + holds @ weights[1:]
    return float(np.mean(np.logaddexp(0, margin) - label * margin))


def fit(table: dict[str, np.ndarray], label: np.ndarray, validation: np.ndarray) -> Ensemble:
    """Rules and weights. The penalty is the largest whose loss on the ``validation`` rows, left out
    for that choice only, is within a twentieth of the best."""
    good = float(label.sum())
    if len(label) == 0:
        return Ensemble(0.0, ())
    if good in (0, len(label)):
        return Ensemble(math.log((good + 1) / (len(label) - good + 1)), ())
    rules = grow_paths(table, label)
    if not rules:
        return Ensemble(math.log((good + 1) / (len(label) - good + 1)), ())
    holds = np.column_stack([rule.holds(table) for rule in rules]).astype(float)
    _, kept = np.unique(holds, axis=1, return_index=True)
    rules, holds = [rules[i] for i in np.sort(kept)], holds[:, np.sort(kept)]
    asked = ~validation
    losses, weights = [], None
    if asked.any() and validation.any():
        for penalty in PENALTIES:
            weights = lasso_logistic(holds[asked], label[asked], penalty, weights)
            losses.append(_loss(weights, holds[validation], label[validation]))
    penalty = next((p for p, x in zip(PENALTIES, losses) if x <= 1.05 * min(losses)), PENALTIES[-1])
    weights = lasso_logistic(holds, label, penalty, weights)
    return Ensemble(float(weights[0]), tuple((r, float(w)) for r, w in zip(rules, weights[1:]) if w))


def _fold(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string"))


def training_table(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample`` rows that are not held out, and which of them
    choose the penalty."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (_fold() % FOLDS != 0))
        .groupBy("doc_id").agg((F.min("quality") > 0).cast("double").alias("label")).orderBy(*order).limit(sample))
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of 16 bytes
    rows = statistics(known.withColumn("validates", F.floor(_fold() / FOLDS) % FOLDS == 0), "doc_id", "label", "validates")
    # An id may stand on any number of rows: the bound holds for rows, too.
    taken = rows.orderBy(*order, *STATISTICS).limit(sample).toPandas()
    return ({n: taken[n].to_numpy(float) for n in STATISTICS}, taken["label"].to_numpy(float), taken["validates"].to_numpy(bool))


def quality_scores(docs: DataFrame, model: Ensemble) -> DataFrame:
    scored = statistics(docs, "doc_id").withColumn("score", model.column())
    return scored.select(
        "doc_id", F.coalesce(_fold() % FOLDS == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    return fit(*training_table(docs, labels, sample))


def op12_quality_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_scores(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
