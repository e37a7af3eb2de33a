import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palaver.functions.formatting import round_numbers
from palaver.sources.tables import COMMENT_OPTIONS, laid_out
from palaver.operators.scoring import drawn_suspects, fetch_by_id, suspect_comments
from palaver.plans import reports
from palaver.plans.pipeline import analyse, write_outputs
from palaver.schemas import FEATURES
from palaver.sources import tables


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    rows = [
        (i, *[rng.random() if rng.random() > 0.1 else None for _ in FEATURES], i % 3,
         -1 if i % 4 == 0 else 1, rng.random() - 0.3)
        for i in range(200)
    ]
    names = ["author_id", *FEATURES, "segment", "anomaly_score", "anomaly_score_val"]
    kinds = ["bigint", *["double"] * 7, "int", "int", "double"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=names)


def test_segment_report(scored):
    df, pdf = scored
    want = pdf.groupby("segment")[list(FEATURES)].mean()
    sizes = pdf.groupby("segment").size()
    for r in reports.segment_report(df).collect():
        assert r["count"] == sizes[r["segment"]]
        for name in FEATURES:
            assert r[name] == pytest.approx(want.loc[r["segment"], name])


def test_anomaly_report_is_a_description(scored):
    df, pdf = scored
    columns = [*FEATURES, "anomaly_score_val"]
    want = pdf[pdf["anomaly_score"] == -1][columns].describe().T
    got = reports.anomaly_report(df)
    assert got.columns == ["metric", *want.columns]
    rows = got.collect()
    assert {r["metric"] for r in rows} == set(columns)
    for r in rows:
        for name in want.columns:
            assert r[name] == pytest.approx(want.loc[r["metric"], name]), (r["metric"], name)


def test_display_and_widths(spark):
    df = spark.createDataFrame([("ab", 1.23456, 7), (None, None, 1234567)], "t string, long_name double, n int")
    shown = reports.report_display(df)
    assert sorted(tuple(r) for r in shown.collect()) == [("", "", "1234567.000"), ("ab", "1.235", "7.000")]
    widths = {r["column_name"]: r["width"] for r in reports.report_widths(df).collect()}
    assert widths == {"t": 2, "long_name": 9, "n": 11}
    assert {r["width"] for r in reports.report_widths(df.limit(0)).collect()} == {1, 9}


def test_rounding_is_half_to_even_on_the_decimal_text(spark):
    df = spark.createDataFrame([(0.0125, 5), (0.0135, 6), (None, None)], "x double, n int")
    assert [tuple(r) for r in round_numbers(df).collect()] == [(0.012, 5), (0.014, 6), (None, None)]


def test_suspects_are_a_repeatable_sample(spark, scored):
    df, pdf = scored
    comments = spark.range(3000).selectExpr(
        "id AS comment_id", "id % 200 AS author_id", "concat('text ', id) AS content")
    top = df.where("segment = 1").select("segment").limit(1)
    first = [tuple(r) for r in suspect_comments(comments, df, top).collect()]
    again = [tuple(r) for r in suspect_comments(comments.repartition(7), df, top).collect()]
    assert first == again and len(first) == len(set(first)) == 100
    assert {user % 3 for user, _ in first} == {1}
    assert [tuple(r) for r in suspect_comments(comments, df, top, size=10).collect()] == first[:10]
    few = suspect_comments(comments.where("comment_id < 30"), df, top)
    assert few.count() == 10 and few.columns == ["user_id", "comment"]


def test_the_whole_analysis(spark, tmp_path):
    rng = random.Random(11)
    start = dt.datetime(2024, 5, 1)
    rows = []
    for author in range(60):
        bot = author < 12
        for n in range(12 if bot else rng.randrange(1, 9)):
            moment = start + (dt.timedelta(minutes=n) if bot else dt.timedelta(hours=rng.randrange(900)))
            text = "buy http://x now" if bot else f"{rng.random()} good day {author} {n}"
            rows.append((len(rows), author, moment, text, 2024))
    comments = spark.createDataFrame(
        rows, "comment_id bigint, author_id bigint, creation_datetime timestamp_ntz, content string, year int")
    lexicon = spark.createDataFrame([("good", 0.7)], "word string, polarity double")
    result = analyse(comments, lexicon, max_clusters=4, restarts=2)
    assert result.features.columns == ["author_id", *FEATURES]
    assert result.scored.count() == 60
    assert result.segments.agg(F.sum("count")).first()[0] == 60
    suspects = {r["comment"] for r in result.suspects.collect()}
    assert suspects == {"buy http://x now"}
    write_outputs(result, str(tmp_path / "out"))
    back = tables.read_report(spark, str(tmp_path / "out/segment_report"), reports.SEGMENT_REPORT)
    assert back.count() == result.segments.count()
    wanted = {r["segment"]: r["link_ratio"] for r in result.segments.collect()}
    for r in back.collect():
        assert r["link_ratio"] == np.round(wanted[r["segment"]], 3)
    assert spark.read.parquet(str(tmp_path / "out/user_features")).count() == 60
    ids = comments.selectExpr("author_id AS id").distinct()
    part = analyse(comments, lexicon, authors=ids, sample=25, year=2024, max_clusters=3, restarts=1)
    assert part.scored.count() == 25


def test_a_hot_author_is_split_in_the_suspect_join(spark):
    """A third of the comments by one author; low thresholds stand in for large data."""
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    comments = spark.range(300_000).selectExpr(
        "id AS comment_id", "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 5000 + 10 END AS author_id",
        "concat('t', id) AS content").repartition(8)
    labels = spark.range(6000).selectExpr("id AS author_id", "CAST(id % 3 AS INT) AS segment")
    top = labels.where("segment = 1").select("segment").limit(1)
    want = [tuple(r) for r in suspect_comments(comments, labels, top).collect()]
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = drawn_suspects(comments, labels, top)
        df.collect()
        got = [tuple(r) for r in suspect_comments(comments, labels, top).collect()]
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == want and len(got) == 100
    assert "SortMergeJoin(skew=true)" in plan


def test_a_fetch_reads_the_years_and_ids_it_asks_for(spark, tmp_path):
    comments = spark.range(4000).selectExpr("id AS comment_id", "id % 7 AS author_id", "concat('t', id) AS content", "CAST(2020 + id % 4 AS INT) AS year")
    path = str(tmp_path / "comments")
    laid_out(comments).write.options(**COMMENT_OPTIONS).partitionBy("year").parquet(path)
    drawn = spark.createDataFrame([(i, 2020 + i % 4) for i in range(0, 4000, 177) if i % 4 < 2], "comment_id long, year int")
    found = fetch_by_id(spark.read.parquet(path), drawn)
    assert sorted(r["comment_id"] for r in found.collect()) == sorted(r["comment_id"] for r in drawn.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "2020" in plan and "2021" in plan and "= 2022" not in plan
    assert "PushedFilters" in plan and "In(comment_id" in plan
    big = suspect_comments(comments, comments.select("author_id").distinct().withColumn("segment", F.lit(1)),
                           spark.createDataFrame([(1,)], "segment int"), size=1500)
    small = suspect_comments(comments, comments.select("author_id").distinct().withColumn("segment", F.lit(1)),
                             spark.createDataFrame([(1,)], "segment int"), size=60)
    assert [tuple(r) for r in big.collect()][:60] == [tuple(r) for r in small.collect()]


def test_a_fetch_is_one_scan_whatever_the_number_of_its_filters(spark):
    comments = spark.range(300).selectExpr("id AS comment_id", "id % 7 AS author_id", "concat('t', id) AS content", "2020 AS year")
    texts = spark.range(300).selectExpr("id AS comment_id", "concat('x', id) AS text")
    found = fetch_by_id(comments.join(texts, "comment_id"), spark.createDataFrame([(i, 2020) for i in range(95)], "comment_id long, year int"))
    assert sorted(r["comment_id"] for r in found.collect()) == list(range(95))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    twice = fetch_by_id(comments, spark.createDataFrame([(i // 2, 2020) for i in range(1, 40)], "comment_id long, year int"))
    assert sorted(r["comment_id"] for r in twice.collect()) == sorted([*range(20), 5, 10, 15])
