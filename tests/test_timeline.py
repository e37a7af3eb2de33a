import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from palaver.operators import timeline
from palaver.plans import features as ft

SCHEMA = "comment_id bigint, author_id bigint, creation_datetime timestamp_ntz, content string"
START = dt.datetime(1969, 12, 31, 22, 0, 0)  # crosses 1970, where microseconds change sign


def make(seed, authors, size, spread_seconds):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(authors), START + dt.timedelta(seconds=rng.randrange(spread_seconds)),
         rng.choice(["a", "b", None, ""]))
        for i in range(size)
    ]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module", params=[
    (1, [1, 2, 3], 400, 60 * 60 * 48),
    (2, [1] * 8 + [2], 500, 200),        # one author holds most rows; many equal moments
    (3, list(range(150)), 300, 10**7),   # mostly one or two comments each
])
def case(request, spark):
    rows = make(*request.param)
    by_author = {}
    for comment_id, author, at, text in sorted(rows, key=lambda r: (r[2], r[0])):
        by_author.setdefault(author, []).append((comment_id, at, text or ""))
    return spark.createDataFrame(rows, SCHEMA), by_author


def hours_between(times):
    return [(later - earlier) / dt.timedelta(hours=1) for earlier, later in zip(times, times[1:])]


def test_gaps_match_brute_force(case):
    comments, by_author = case
    got = {r["comment_id"]: r["gap_hours"] for r in timeline.comment_gaps(comments).collect()}
    want = {}
    for said in by_author.values():
        gaps = [None, *hours_between([at for _, at, _ in said])]
        want.update((comment_id, gap) for (comment_id, _, _), gap in zip(said, gaps))
    assert got.keys() == want.keys()
    for comment_id, gap in want.items():
        assert got[comment_id] == (None if gap is None else pytest.approx(gap)), comment_id


def test_burstiness_matches_brute_force(case):
    comments, by_author = case
    got = {r["author_id"]: r["burstiness_hours"] for r in timeline.burstiness(comments).collect()}
    for author, said in by_author.items():
        gaps = hours_between([at for _, at, _ in said])
        if len(gaps) == 1:
            assert got[author] is None
        else:
            assert got[author] == pytest.approx(statistics.stdev(gaps) if gaps else 0.0, abs=1e-12), author


def test_duplicates_match_brute_force(case):
    comments, by_author = case
    want = {}
    for said in by_author.values():
        seen = set()
        for comment_id, _, text in said:
            want[comment_id] = text in seen
            seen.add(text)
    assert {r["comment_id"]: r["is_repeat"] for r in timeline.duplicate_flags(comments).collect()} == want


def test_flags_average_to_the_repeated_ratio(case):
    comments, _ = case
    shares = timeline.duplicate_flags(comments).groupBy("author_id").agg(
        F.avg(F.col("is_repeat").cast("double")).alias("share"))
    both = shares.join(ft.repeated_ratio(comments), "author_id")
    assert both.where("abs(share - repeated_ratio) > 1e-12").count() == 0


def test_an_author_lies_in_many_partitions(spark):
    """One author has most moments; every partition but the first is stitched to the one before."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        comments = spark.range(6000).selectExpr(
            "id AS comment_id", "CASE WHEN id % 3 = 0 THEN id ELSE -1 END AS author_id",
            "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT), 0) AS creation_datetime", "'x' AS content")
        ordered = timeline.moments_in_order(comments)
        gaps = ordered.where("author_id = -1").selectExpr("(at - previous) / 60000000 AS minutes").collect()
        parts = ordered.where("author_id = -1").select(F.input_file_name()).distinct().count()
        plan = timeline.burstiness(comments)._jdf.queryExecution().executedPlan().toString()
        burst = timeline.burstiness(comments).where("author_id = -1").first()["burstiness_hours"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    minutes = [r["minutes"] for r in gaps]
    assert parts > 2 and minutes.count(None) == 1 and sorted(m for m in minutes if m) == [1.0] * 2000 + [2.0] * 1999
    assert burst == pytest.approx(statistics.stdev([m / 60 for m in minutes if m]))
    assert "Window" not in plan
