"""Segments: KMeans for each candidate number of clusters, chosen by silhouette.

All candidates and all their restarts are fitted together: one pass over the authors assigns
every author in every model that still moves and returns the sums from which all centres move.
The number of jobs grows with the iterations, not with the number of models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from palaver.session import stage

#: Authors from which starting centres are drawn, at most.
START_ROWS = 4096
#: Authors in a slice, the unit of a partial sum: sums go by slices, so that they do not depend
#: on the number of partitions.
SLICE_ROWS = 1 << 16
MAX_SLICES = 4096
#: Slices whose sums the driver adds itself: a kilobyte for each model and slice, in the same order.
FEW_SLICES = 16
#: Columns have unit variance: a model rests once the squared moves of its centres sum to this.
REST = 1e-4
MAX_PASSES = 300
#: Rows whose distances are held at a time.
TILE = 2048
#: Rows on each side of a tile of the exact silhouette, whose distances stay in a processor's cache.
SIDE = 256
#: Rows of a panel of the exact silhouette, at most, and panels of a small input.
PANEL_ROWS = 1 << 16
LEAST_PANELS = 8


def silhouette_squared(labelled: DataFrame, columns: Sequence[str], label: str = "segment") -> float:
    """Mean silhouette on squared Euclidean distance; linear in the number of rows."""
    points = VectorAssembler(inputCols=list(columns), outputCol="_vector").transform(labelled)
    return ClusteringEvaluator(
        featuresCol="_vector", predictionCol=label, distanceMeasure="squaredEuclidean"
    ).evaluate(points.withColumn(label, F.col(label).cast("double")))


def silhouette_exact(
    labelled: DataFrame, columns: Sequence[str], label: str = "segment",
    panel_rows: int | None = None,
) -> DataFrame:
    """Mean silhouette on Euclidean distance as one row: ``score``.

    This metric needs every distance. Rows are cut into panels, and each unordered pair of panels
    is one group of bounded size, whose distances serve the rows of both. A group works through
    them in tiles and returns one row of sums, a column per segment, for each of its rows. A row
    is sent once per panel: rows / PANEL_ROWS times. The work is still quadratic: use it for up
    to a few million authors.
    """
    names = list(columns)
    sizes = {r["segment"]: r["size"] for r in labelled.groupBy(F.col(label).alias("segment")).agg(
        F.count("*").alias("size")).collect()}
    order = sorted(sizes)
    total = sum(sizes.values())
    most = panel_rows or min(PANEL_ROWS, max(1, -(-total // LEAST_PANELS)))
    panels = max(1, -(-total // most))
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(label)) - 1 if order else F.lit(0)
    rows = labelled.select(
        "author_id", place.cast("int").alias("own"), *names,
        F.pmod(F.xxhash64("author_id"), F.lit(panels)).cast("int").alias("panel"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(panels - 1)))).withColumns({
        "i": F.least("panel", "other"), "j": F.greatest("panel", "other")}).drop("other")

    def distance_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a = pdf[pdf["panel"] == i]
        b = a if i == j else pdf[pdf["panel"] == j]
        x, y = a[names].to_numpy(float), b[names].to_numpy(float)
        of_x, of_y = (np.eye(len(order))[p["own"].to_numpy()] for p in (a, b))
        sums_x, sums_y = np.zeros((len(x), len(order))), np.zeros((len(y), len(order)))
        for s, t, distance in _distances(x, y):
            if i == j and s == t:
                np.fill_diagonal(distance, 0.0)
            sums_x[s:s + SIDE] += distance @ of_y[t:t + SIDE]
            if i != j:
                sums_y[t:t + SIDE] += distance.T @ of_x[s:s + SIDE]
        found = [(a, sums_x)] if i == j else [(a, sums_x), (b, sums_y)]
        return pd.concat([
            pd.DataFrame({"author_id": p["author_id"].to_numpy(), "own": p["own"].to_numpy(),
                          **{f"t{n}": sums[:, n] for n in range(len(order))}}) for p, sums in found])

    sums = met.groupBy("i", "j").applyInPandas(
        distance_sums, "author_id long, own int" + "".join(f", t{n} double" for n in range(len(order))))
    per_row = sums.groupBy("author_id", "own").agg(*[F.sum(f"t{n}").alias(f"t{n}") for n in range(len(order))])
    inner, outer, size = F.lit(None), [], F.lit(None)
    for n, segment in enumerate(order):
        mine = F.col("own") == n
        size = F.when(mine, F.lit(sizes[segment])).otherwise(size)
        inner = F.when(mine, F.try_divide(F.col(f"t{n}"), F.lit(sizes[segment] - 1))).otherwise(inner)
        outer.append(F.when(~mine, F.col(f"t{n}") / sizes[segment]))
    nearest = F.least(*outer) if len(outer) > 1 else F.lit(None).cast("double")
    value = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per_row.select(size.alias("size"), inner.cast("double").alias("a"), nearest.alias("b")).agg(F.avg(value).alias("score"))


def _distances(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Distances of all rows of both sides, a tile at a time: where it begins on each side, and the tile, whose
    place the next one takes. |x|^2 + |y|^2 - 2xy is one product of rows that are two columns longer."""
    left = np.column_stack([-2.0 * x, (x**2).sum(1), np.ones(len(x))])
    right = np.column_stack([y, np.ones(len(y)), (y**2).sum(1)]).T.copy()
    place = np.empty((SIDE, SIDE))
    for s in range(0, len(x), SIDE):
        for t in range(0, len(y), SIDE):
            a, b = left[s:s + SIDE], right[:, t:t + SIDE]
            tile = np.matmul(a, b, out=place[:len(a), :b.shape[1]])
            yield s, t, np.sqrt(np.maximum(tile, 0.0, out=tile), out=tile)


def _nearest(centres: Sequence[Sequence[float]], columns: Sequence[str]) -> Column:
    """Number of the nearest centre, ties to the smaller one."""
    def distance(centre: Sequence[float]) -> Column:
        terms = [(F.col(n) - F.lit(float(v))) ** 2 for n, v in zip(columns, centre)]
        return sum(terms[1:], terms[0])

    return F.array_min(F.array(*[
        F.struct(distance(c).alias("d"), F.lit(i).alias("s")) for i, c in enumerate(centres)]))["s"]


def assign_segments(points: DataFrame, centres: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``author_id`` and ``segment`` of the nearest centre, ties to the smaller segment.

    ``centres`` has a row per segment, at most as many as a choice of k looks at.
    """
    rows = centres.select("segment", *columns).orderBy("segment").collect()
    numbers = F.array(*[F.lit(c["segment"]) for c in rows])
    place = _nearest([[c[n] for n in columns] for c in rows], columns)
    return points.select("author_id", F.get(numbers, place).alias("segment"))


@dataclass
class Model:
    """Centres of one restart of one k, and what the last pass has found about them."""

    centres: np.ndarray
    moving: bool = True
    sizes: np.ndarray | None = None
    totals: np.ndarray | None = None
    squares: np.ndarray | None = None

    @property
    def cost(self) -> float:
        """Sum of squared distances to the nearest centre."""
        c = self.centres
        return float(self.squares.sum() - 2 * (self.totals * c).sum() + (self.sizes * (c**2).sum(1)).sum())

    def labels(self, x: np.ndarray, products: np.ndarray) -> np.ndarray:
        return np.argmin((self.centres**2).sum(1) - 2 * products, axis=1)

    def silhouettes(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Of every row, on squared distance, whose mean to a group follows from the group's sums."""
        n = self.sizes
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.maximum((x**2).sum(1)[:, None] + self.squares / n - 2 * x @ (self.totals / n[:, None]).T, 0.0)
            mean[:, n == 0] = np.inf
            rows = np.arange(len(x))
            inner = mean[rows, labels] * n[labels] / (n[labels] - 1)
            mean[rows, labels] = np.inf
            outer = mean.min(axis=1)
            value = (outer - inner) / np.maximum(inner, outer)
        value[(n[labels] == 1) | ~np.isfinite(value)] = 0.0
        return value


def _added(sums: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``sums`` and the weights of each label, added one after the other: cutting the rows into
    other batches changes nothing."""
    return np.bincount(np.append(np.arange(len(sums)), labels), np.append(sums, weights), len(sums))


def _pass(points: DataFrame, columns: Sequence[str], models: list[Model], measure: Callable, slices: int = 1) -> list[np.ndarray]:
    """For every model the sums over all authors that ``measure`` adds up: one job.

    ``measure(model, x, labels, sums)`` returns the new sums; the first ones are given by
    ``measure(model)``. Partial sums are made per slice and added in the order of slices.
    """
    names = list(columns)
    bounds = np.cumsum([0] + [len(m.centres) for m in models])
    everything = np.concatenate([m.centres for m in models])

    def add(sums: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        for low in range(0, len(x), TILE):
            part = x[low:low + TILE]
            products = part @ everything.T
            for i, model in enumerate(models):
                labels = model.labels(part, products[:, bounds[i]:bounds[i + 1]])
                sums[i] = measure(model, part, labels, sums[i])
        return sums

    def rows_of(slice_number: int, sums: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "slice": pa.array([slice_number] * len(models), pa.int32()),
            "model": pa.array(range(len(models)), pa.int32()),
            "sums": pa.array([s.ravel() for s in sums], pa.list_(pa.float64()))})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, []
        for batch in batches:
            numbers = batch.column("slice").to_numpy()
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if numbers[low] != current:
                    if current is not None:
                        yield rows_of(current, sums)
                    current, sums = int(numbers[low]), [measure(m) for m in models]
                sums = add(sums, x[low:high])
        if current is not None:
            yield rows_of(current, sums)

    parts = points.select("slice", *names).mapInArrow(work, "slice int, model int, sums array<double>")
    found: dict[int, np.ndarray] = {}
    for row in _in_order(parts, slices).toLocalIterator() if slices > FEW_SLICES else sorted(parts.collect()):
        known = found.get(row["model"])
        found[row["model"]] = np.array(row["sums"]) if known is None else known + np.array(row["sums"])
    return [found[i] for i in range(len(models))]


def _in_order(parts: DataFrame, slices: int) -> DataFrame:
    """The sums of each model, those of many slices added by tasks, in the order of slices."""
    inside = F.transform(F.sort_array(F.collect_list(F.struct("slice", "sums"))), lambda p: p["sums"])
    return parts.groupBy("model").agg(inside.alias("parts")).select("model", F.aggregate(
        F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0)),
        lambda done, more: F.zip_with(done, more, lambda a, b: a + b)).alias("sums"))


def _moments(model: Model, x=None, labels=None, sums=None) -> np.ndarray:
    """Per centre: rows, totals of the columns, sum of squared lengths."""
    if x is None:
        return np.zeros((model.centres.shape[1] + 2, len(model.centres)))
    weights = [np.ones(len(x)), *x.T, (x**2).sum(1)]
    return np.stack([_added(s, labels, w) for s, w in zip(sums, weights)])


def _silhouette_sum(model: Model, x=None, labels=None, sums=None) -> np.ndarray:
    if x is None:
        return np.zeros(1)
    return _added(sums, np.zeros(len(x), np.int64), model.silhouettes(x, labels))


def _measure_moments(points: DataFrame, columns: Sequence[str], models: list[Model], slices: int) -> None:
    for model, sums in zip(models, _pass(points, columns, models, _moments, slices)):
        table = sums.reshape(len(columns) + 2, len(model.centres))
        model.sizes, model.totals, model.squares = table[0], table[1:-1].T, table[-1]


def _starts(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the rows, each drawn with odds in proportion to its squared distance from those before."""
    chosen = [rows[rng.integers(len(rows))]]
    nearest = np.full(len(rows), np.inf)
    while len(chosen) < k:
        nearest = np.minimum(nearest, ((rows - chosen[-1]) ** 2).sum(1))
        odds = nearest.sum()
        chosen.append(rows[rng.choice(len(rows), p=nearest / odds) if odds > 0 else rng.integers(len(rows))])
    return np.array(chosen)


def _fit(points: DataFrame, columns: Sequence[str], models: list[Model], slices: int) -> None:
    """Moves the centres of all models until each rests; a centre without authors stays."""
    for _ in range(MAX_PASSES):
        moving = [m for m in models if m.moving]
        if not moving:
            return
        _measure_moments(points, columns, moving, slices)
        for model in moving:
            means = np.where(model.sizes[:, None] > 0, model.totals / np.maximum(model.sizes, 1)[:, None], model.centres)
            model.moving = bool(((means - model.centres) ** 2).sum() > REST)
            model.centres = means


def choose_segments(
    scaled: DataFrame,
    columns: Sequence[str],
    max_clusters: int = 10,
    restarts: int = 10,
    seed: int = 42,
    metric: str = "squared",
    start_rows: int = START_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Labelled authors, and a table (k, silhouette, cost, metric) with the chosen k first.

    Each k keeps the cheapest of its restarts; the best silhouette wins, ties go to the smaller
    k. Centres start from ``start_rows`` authors with the smallest hash of seed and id, drawn one
    after the other by distance; all passes go over all authors. Authors are dealt into slices by
    a hash of their id and sorted, and sums are added in that order: neither the split of the
    input nor the size of the cluster changes a result.
    """
    authors = scaled.count()
    if authors < 2 or max_clusters < 2:
        raise ValueError("segments need at least two authors and max_clusters of at least 2")
    spark = scaled.sparkSession
    slices = min(MAX_SLICES, -(-authors // slice_rows))
    points = (
        scaled.withColumn("slice", F.pmod(F.xxhash64("author_id"), F.lit(slices)).cast("int"))
        .repartition(slices, "slice").sortWithinPartitions("slice", "author_id").persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        ticket = F.xxhash64(F.lit(seed), F.col("author_id"))
        drawn = np.array(points.orderBy(ticket, "author_id").limit(start_rows).select(*columns).collect(), float)
        candidates = range(2, min(max_clusters, authors) + 1)
        restarts_of = {k: [Model(_starts(drawn, k, np.random.default_rng([seed, k, r]))) for r in range(restarts)] for k in candidates}
        models = [m for k in candidates for m in restarts_of[k]]
        _fit(points, columns, models, slices)
        _measure_moments(points, columns, models, slices)
        best = {k: min(restarts_of[k], key=lambda m: m.cost) for k in candidates}
        for model in best.values():  # numbered by their centres, so that equal runs get equal numbers
            order = np.lexsort(model.centres.T[::-1])
            model.centres, model.sizes = model.centres[order], model.sizes[order]
            model.totals, model.squares = model.totals[order], model.squares[order]
        label = lambda k: scaled.withColumn("segment", _nearest(best[k].centres, columns))
        if metric == "euclidean":
            scores = {k: silhouette_exact(label(k), columns).first()["score"] for k in candidates}
        else:
            sums = _pass(points, columns, list(best.values()), _silhouette_sum, slices)
            scores = {k: float(s[0]) / authors for k, s in zip(best, sums)}
    finally:
        points.unpersist()
    for k, model in best.items():
        if (model.sizes > 0).sum() < 2:
            scores[k] = -1.0  # a single cluster has no silhouette
    if max(scores.values()) <= -1:
        raise ValueError("no number of clusters gave a silhouette")
    table = spark.createDataFrame(
        [(k, float(scores[k]), best[k].cost, metric) for k in candidates],
        "k int, silhouette double, cost double, metric string",
    ).orderBy(F.desc("silhouette"), "k")
    chosen = max(candidates, key=lambda k: (scores[k], -k))
    return stage(label(chosen), "labelled"), table
