import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.operators import quantiles, scoring, segmentation
from palaver.operators.forest import anomaly_scores, fit_forest
from palaver.operators.quantiles import exact_quantiles
from palaver.operators.scaling import scaled_features, z_scores
from palaver.operators.segmentation import choose_segments, silhouette_exact, silhouette_squared

XY = ["x", "y"]


def points(spark, rows):
    return spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], "author_id bigint, x double, y double")


def blobs(seed, centres, size):
    rng = random.Random(seed)
    return [(cx + rng.gauss(0, 0.1), cy + rng.gauss(0, 0.1)) for cx, cy in centres for _ in range(size)]


def test_scaling(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "author_id bigint, x double, y double")
    got = {r["author_id"]: (r["x"], r["y"]) for r in scaled_features(df, XY).collect()}
    filled = np.array([1.0, 3.0, 0.0])
    want = (filled - filled.mean()) / filled.std()
    for i, value in enumerate(want, start=1):
        assert got[i] == (pytest.approx(value), 0.0)
    z = {r["author_id"]: (r["z_x"], r["z_y"]) for r in z_scores(df, XY).collect()}
    assert z == {1: (-1.0, 0.0), 2: (1.0, 0.0), 3: (None, 0.0)}


def test_the_moments_are_computed_once(spark, tmp_path):
    path = str(tmp_path / "t")
    points(spark, [(1, 2), (3, 4)]).write.parquet(path)
    plan = scaled_features(spark.read.parquet(path), XY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def brute_silhouette(rows, labels, power):
    a = np.array(rows)
    distance = np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1)) ** power
    values = []
    for i, label in enumerate(labels):
        same = np.array([x == label for x in labels])
        if same.sum() == 1:
            values.append(0.0)
            continue
        inner = distance[i, same].sum() / (same.sum() - 1)
        outer = min(distance[i, np.array(labels) == o].mean() for o in set(labels) - {label})
        values.append((outer - inner) / max(inner, outer) if max(inner, outer) else 0.0)
    return float(np.mean(values))


@pytest.mark.parametrize("panel_rows", [None, 17, 2048])
def test_silhouettes_match_brute_force(spark, panel_rows):
    rows = blobs(2, [(0, 0), (1, 1), (3, 0)], 30) + [(9.0, 9.0)]
    labels = [i // 30 for i in range(len(rows))]
    df = points(spark, rows).withColumn("segment", F.floor(F.col("author_id") / 30).cast("int"))
    assert silhouette_exact(df, XY, panel_rows=panel_rows).first()["score"] == pytest.approx(
        brute_silhouette(rows, labels, 1))
    assert silhouette_squared(df, XY) == pytest.approx(brute_silhouette(rows, labels, 2))


def test_distances_come_in_small_tiles(spark):
    """Sides that are no multiple of a tile's, equal rows, and a silhouette over several tiles of a panel."""
    from palaver.operators import segmentation

    x, y = np.random.default_rng(4).normal(size=(2, 600, 7))
    y = np.concatenate([y, x[:5]])[:563]
    whole = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    got = np.full(whole.shape, np.nan)
    for s, t, tile in segmentation._distances(x, y):
        assert tile.nbytes <= 8 * segmentation.SIDE**2 <= 1 << 20
        got[s:s + len(tile), t:t + tile.shape[1]] = tile
    assert got == pytest.approx(whole, abs=1e-6)
    rows = blobs(3, [(0, 0), (1, 1), (3, 0)], 200)
    df = points(spark, rows).withColumn("segment", F.floor(F.col("author_id") / 200).cast("int"))
    want = pytest.approx(brute_silhouette(rows, [i // 200 for i in range(600)], 1))
    assert silhouette_exact(df, XY).first()["score"] == want == silhouette_exact(df, XY, panel_rows=600).first()["score"]


@pytest.mark.parametrize("metric", ["squared", "euclidean"])
def test_segments_find_separate_blobs(spark, metric):
    centres = [(0, 0), (5, 5), (0, 5)]
    df = points(spark, blobs(1, centres, 40))
    labelled, scores = choose_segments(df, XY, max_clusters=5, restarts=3, metric=metric)
    table = scores.collect()
    assert table[0]["k"] == 3 and sorted(r["k"] for r in table) == [2, 3, 4, 5]
    groups = {}
    for r in labelled.collect():
        groups.setdefault(r["author_id"] // 40, set()).add(r["segment"])
    # Numbered by centre: (0, 0), (0, 5), (5, 5).
    assert groups == {0: {0}, 2: {1}, 1: {2}}


def test_segments_do_not_depend_on_how_the_input_is_split(spark):
    df = points(spark, blobs(4, [(0, 0), (2, 1), (1, 3)], 30))
    results = []
    for split in (1, 5, 9):
        shuffled = df.orderBy(F.xxhash64("author_id", F.lit(split))).repartition(split)
        labelled, scores = choose_segments(shuffled, XY, max_clusters=4, restarts=2, slice_rows=20)
        table = [(r["k"], r["silhouette"], r["cost"]) for r in scores.collect()]
        results.append((sorted((r["author_id"], r["segment"]) for r in labelled.collect()), table))
    assert results[0] == results[1] == results[2]


def test_one_pass_serves_all_models(spark, monkeypatch):
    jobs = []
    ask = segmentation._pass
    monkeypatch.setattr(segmentation, "_pass", lambda *a: (jobs.append(len(a[2])), ask(*a))[1])
    df = points(spark, blobs(6, [(0, 0), (4, 1), (1, 5)], 30))
    choose_segments(df, XY, max_clusters=6, restarts=5)
    # Every pass has all models that still move; the last two measure the costs and the silhouettes.
    assert jobs[0] == jobs[-2] == 25 and jobs[-1] == 5
    assert len(jobs) <= segmentation.MAX_PASSES + 2 and jobs[:-2] == sorted(jobs[:-2], reverse=True)


@pytest.mark.parametrize("slice_rows, few", [(1 << 16, 16), (13, 16), (13, 0)])
def test_costs_and_silhouettes_of_the_choice(spark, monkeypatch, slice_rows, few):
    monkeypatch.setattr(segmentation, "FEW_SLICES", few)
    rows = blobs(8, [(0, 0), (3, 1), (1, 4), (6, 6)], 20)
    df = points(spark, rows)
    labelled, scores = choose_segments(df, XY, max_clusters=5, restarts=3, slice_rows=slice_rows)
    first = scores.first()
    labels = {r["author_id"]: r["segment"] for r in labelled.collect()}
    assert first["k"] == 4
    assert first["silhouette"] == pytest.approx(brute_silhouette(rows, [labels[i] for i in range(len(rows))], 2))
    assert first["silhouette"] == pytest.approx(silhouette_squared(labelled, XY))
    groups = {s: np.array([rows[i] for i in labels if labels[i] == s]) for s in set(labels.values())}
    assert first["cost"] == pytest.approx(sum(((g - g.mean(0)) ** 2).sum() for g in groups.values()))


def test_equal_authors_have_no_segments(spark):
    with pytest.raises(ValueError):
        choose_segments(points(spark, [(1, 1)] * 6), XY, max_clusters=3, restarts=2)


def test_segments_need_two_authors(spark):
    with pytest.raises(ValueError):
        choose_segments(points(spark, [(1, 1)]), XY)


def test_segments_never_exceed_the_number_of_authors(spark):
    _, scores = choose_segments(points(spark, [(0, 0), (4, 4), (9, 0)]), XY, restarts=2)
    assert scores.first()["k"] == 2


def test_forest_isolates_planted_outliers(spark):
    rows = blobs(3, [(0, 0)], 500) + [(4, 4), (-5, 3), (6, -6)]
    df = points(spark, rows)
    scored = anomaly_scores(df, XY, contamination=0.05).collect()
    n = len(rows)
    lowest = sorted(scored, key=lambda r: r["anomaly_score_val"])[:3]
    assert {r["author_id"] for r in lowest} == {n - 1, n - 2, n - 3}
    flagged = [r for r in scored if r["anomaly_score"] == -1]
    assert all(r["anomaly_score_val"] < 0 for r in flagged)
    assert all(r["anomaly_score_val"] >= 0 for r in scored if r["anomaly_score"] == 1)
    distinct = len({r["anomaly_score_val"] for r in scored})
    assert distinct < n or len(flagged) == math.ceil(0.05 * (n - 1))
    assert abs(len(flagged) - 0.05 * n) <= 0.02 * n


def test_forest_does_not_depend_on_partitions(spark):
    df = points(spark, blobs(4, [(0, 0), (2, 2)], 700))
    first = fit_forest(df, XY, trees=7)
    again = fit_forest(df.repartition(5).orderBy("y"), XY, trees=7)
    assert first == again
    assert [t["sample_rows"] for t in first] == [256] * 7
    assert all(len(t["feature"]) <= 511 for t in first)
    assert fit_forest(df, XY, seed=1, trees=7) != first


def test_forest_of_few_or_equal_rows(spark):
    same = anomaly_scores(points(spark, [(1, 1)] * 5), XY).collect()
    assert {r["anomaly_score"] for r in same} == {1} and {r["anomaly_score_val"] for r in same} == {0.0}
    assert anomaly_scores(points(spark, [(1, 1)]), XY).count() == 1


def test_quantiles_are_exact(spark):
    rng = random.Random(9)
    x = [rng.gauss(0, 1) for _ in range(5000)]
    y = [rng.choice([1.0, 2.0, 7.0]) for _ in range(4000)] + [None] * 1000
    z = [float(i) for i in range(5000)]
    rng.shuffle(z)
    df = spark.createDataFrame(list(zip(x, y, z)), "x double, y double, z double").repartition(6)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["x", "y", "z"], probs)
    for name, values in (("x", x), ("y", [v for v in y if v is not None]), ("z", z)):
        for prob in probs:
            assert got[name, prob] == pytest.approx(np.quantile(values, prob), rel=1e-12, abs=1e-12)
    assert exact_quantiles(df.where("x > 99"), ["x"], [0.5]) == {("x", 0.5): None}


def test_quantiles_of_tied_values(spark):
    # Half of 200,000 values are 0, so that the median lies at the edge of the tie.
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    values = np.array([0.0 if i % 2 == 0 else float(i) for i in range(200_000)])
    probs = [0.0, 0.25, 0.4999, 0.5, 0.500001, 0.75, 1.0]
    got = exact_quantiles(df, ["v"], probs)
    assert [got["v", p] for p in probs] == pytest.approx([np.quantile(values, p) for p in probs])


def test_a_tie_is_one_row_and_ranks_come_from_few_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(10_000).select(F.least(F.col("id"), F.lit(5000)).cast("double").alias("v"), F.lit(1.0).alias("w"))
        ordered = quantiles._ordered(quantiles.value_counts(df, ["v", "w"]))
        assert ordered.count() == 5002
        assert ordered.select("part").distinct().count() > 3
        got = exact_quantiles(df, ["v", "w"], [0.1, 0.3, 0.9])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    values = np.minimum(np.arange(10_000), 5000)
    assert got == pytest.approx({**{("v", p): np.quantile(values, p) for p in (0.1, 0.3, 0.9)}, **{("w", p): 1.0 for p in (0.1, 0.3, 0.9)}})


def test_composite_and_top_segment(spark):
    rows = [(i, i % 3, float(i % 5), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "author_id bigint, segment int, repeated_ratio double, link_ratio double")
    got = scoring.composite_score(df)
    assert set(got.columns) == {*df.columns, "composite_score"}
    values = np.array([r[2] for r in rows])
    want = (values - values.mean()) / values.std()
    for r in got.collect():
        assert r["composite_score"] == pytest.approx(want[r["author_id"]])
    even = df.withColumn("composite_score", F.lit(1.0))
    assert scoring.top_segment(even).first()["segment"] == 0
    anomalous = df.withColumn("anomaly_score_val", F.when(F.col("segment") == 2, -1.0).otherwise(1.0))
    assert scoring.top_segment(scoring.composite_score(anomalous)).first()["segment"] == 2
