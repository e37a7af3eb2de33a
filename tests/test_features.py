import datetime as dt
import hashlib
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from palaver.functions.text import words
from palaver.plans import features as ft
from palaver.schemas import FEATURES
from palaver.session import stage, work_dir
from palaver.operators import timeline

SCHEMA = "comment_id bigint, author_id bigint, creation_datetime timestamp_ntz, content string, year int"
T0 = dt.datetime(2024, 3, 1, 10, 0, 0)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def frame(spark, rows):
    """Rows of (author, time, text)."""
    return spark.createDataFrame(
        [(i, a, t, c, 2024) for i, (a, t, c) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(
        [("good", 1.0), ("bad", -1.0), ("fair", 0.5)], "word string, polarity double")


def features(spark, rows, lexicon):
    return {r["author_id"]: r for r in ft.author_features(frame(spark, rows), lexicon).collect()}


def test_hand_worked_authors(spark, lexicon):
    rows = [
        (1, at(0), "a a b"),
        (2, at(0), "same"), (2, at(1), "same"),
        (3, at(0), "x"), (3, at(1), "y"), (3, at(3), "z"),
        (4, dt.datetime(2024, 3, 1, 0, 30), "p"), (4, dt.datetime(2024, 3, 2, 0, 29), "q"),
        (5, at(0), None), (5, at(1), ""), (5, at(2), "  "),
        (6, at(0), "HTTPS://x"), (6, at(1), "htt p"),
        (7, at(0), "1"), (7, at(24), "2"), (7, at(48), "3"), (7, at(49), "4"),
        (None, at(0), "dropped"),
        (8, None, "m"), (8, None, "n"),
        (9, at(0), "Good good bad"), (9, at(1), "nothing"), (9, at(2), "fair"),
    ]
    got = features(spark, rows, lexicon)
    assert set(got) == set(range(1, 10))
    one = got[1]
    assert one["lexical_diversity"] == pytest.approx(2 / 3)
    assert (one["repeated_ratio"], one["comments_per_day"]) == (0, 1)
    assert (one["burstiness_hours"], one["hour_entropy"]) == (0, 0)
    assert (got[2]["repeated_ratio"], got[2]["comments_per_day"]) == (0.5, 2)
    assert got[2]["burstiness_hours"] is None
    assert got[3]["burstiness_hours"] == pytest.approx(0.5**0.5)
    assert got[4]["comments_per_day"] == 2
    assert got[5]["lexical_diversity"] == 0
    assert got[5]["repeated_ratio"] == pytest.approx(1 / 3)
    assert got[6]["link_ratio"] == 0.5
    assert got[7]["hour_entropy"] == pytest.approx(0.8112781244591328)
    assert got[7]["comments_per_day"] == 2
    eight = got[8]
    assert (eight["comments_per_day"], eight["burstiness_hours"], eight["hour_entropy"]) == (0, 0, 0)
    assert got[9]["sentiment_polarity"] == pytest.approx((1 / 3 + 0 + 0.5) / 3)


def test_single_features_agree_with_the_joint_table(spark, lexicon):
    rng = random.Random(3)
    texts = ["good a", "bad http://x", None, "", "q  w e", "fair fair", "Zed"]
    rows = [(rng.randrange(6) or None, at(rng.randrange(400) / 7), rng.choice(texts)) for _ in range(300)]
    comments = frame(spark, rows)
    joint = {r["author_id"]: r.asDict() for r in ft.author_features(comments, lexicon).collect()}
    singles = {
        "lexical_diversity": ft.lexical_diversity(comments),
        "repeated_ratio": ft.repeated_ratio(comments),
        "link_ratio": ft.link_ratio(comments),
        "sentiment_polarity": ft.sentiment_polarity(comments, lexicon),
        "comments_per_day": ft.comments_per_day(comments),
        "burstiness_hours": timeline.burstiness(comments),
        "hour_entropy": ft.hour_entropy(comments),
    }
    assert set(singles) == set(FEATURES)
    for name, df in singles.items():
        values = {r["author_id"]: r[name] for r in df.collect()}
        assert values.keys() == joint.keys()
        for author, value in values.items():
            assert value == pytest.approx(joint[author][name]), name


def test_features_do_not_depend_on_order_or_partitions(spark, lexicon):
    rng = random.Random(5)
    rows = [(rng.randrange(5), at(rng.randrange(900) / 3), f"t{rng.randrange(20)} good") for _ in range(200)]
    comments = frame(spark, rows)
    shuffled = comments.orderBy(F.hash("comment_id")).repartition(7)
    order = lambda df: sorted(
        tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert order(ft.author_features(comments, lexicon)) == order(ft.author_features(shuffled, lexicon))


@pytest.mark.parametrize("text", [
    "a b", "a\u001cb", "a​b", " a \t\n b ", "　a b c\u0085d", "", "  ", "a᠎b﻿c",
    "   x\u001f\u001e\u001dy\u000b\u000c", "a\u0000b\u0008c\u000ed\u001be",
])
def test_words_split_where_python_splits(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(words(F.col("t")).alias("w")).first()["w"]
    assert got == text.split()


def test_every_character_separates_as_in_python(spark):
    points = [c for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, t string")
    cut = {r["c"] for r in rows.where(F.size(words(F.col("t"))) == 2).collect()}
    assert cut == {c for c in points if chr(c).isspace()}


def test_time_differences_ignore_the_session_zone(spark, lexicon):
    rows = [(1, dt.datetime(2024, 3, 31, 1, 0), "a"), (1, dt.datetime(2024, 3, 31, 4, 0), "b"),
            (1, dt.datetime(2024, 3, 31, 5, 0), "c")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = features(spark, rows, lexicon)[1]["burstiness_hours"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == pytest.approx(2**0.5)


def test_sample_and_selection(spark):
    comments = frame(spark, [(a, at(a), "x") for a in range(20)])
    ids = comments.select(F.col("author_id").alias("id"))
    drawn = lambda df, n, **more: sorted(r["id"] for r in ft.sample_authors(df, n, **more).collect())
    first = drawn(ids, 5)
    assert first == drawn(ids.repartition(3), 5) != drawn(ids, 5, seed=7) and len(first) == 5
    assert drawn(ids, 30) == list(range(20)) and drawn(ids, 0) == [] and drawn(ids.where("id > 99"), 4) == []
    chosen = ft.select_comments(comments, ft.sample_authors(ids, 5), 2024)
    assert sorted(r["author_id"] for r in chosen.collect()) == sorted(first)
    assert ft.select_comments(comments, year=1999).count() == 0
    assert ft.select_comments(comments).count() == 20
    assert tuple(ft.corpus_counts(comments).first()) == (20, 20)


def test_a_hot_author_is_split_and_stays_whole(spark):
    """One author with most of the text: small split sizes force adaptive splitting."""
    comments = spark.range(60_000).selectExpr(
        "id AS comment_id",
        "CASE WHEN id % 3 < 2 THEN 1 ELSE id % 50 + 10 END AS author_id",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS creation_datetime",
        "concat_ws(' ', 'w', id % 1000, hash(id), hash(id + 1)) AS content", "2024 AS year")
    want = {r["author_id"]: r["lexical_diversity"] for r in comments.select(
        "author_id", F.explode(F.split("content", " ")).alias("w")).groupBy("author_id").agg(
        (F.count_distinct("w") / F.count("w")).alias("lexical_diversity")).collect()}
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = ft.lexical_diversity(comments)
        got = {r["author_id"]: r["lexical_diversity"] for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == pytest.approx(want)
    assert "AQEShuffleRead" in plan and "skewed" in plan


def test_a_sample_sorts_its_border_only(spark, monkeypatch):
    monkeypatch.setattr(ft, "_BORDER_ROWS", 3)
    monkeypatch.setattr(ft, "_DIGITS", 1)
    ids = spark.range(5000).withColumnRenamed("id", "id")
    want = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i in range(5000))
    for size in (1, 17, 2500, 4999, 5000):
        assert sorted(r["id"] for r in ft.sample_authors(ids, size).collect()) == sorted(i for _, i in want[:size])
    copies = ids.where("id < 2").crossJoin(spark.range(6).select(F.col("id").alias("copy"))).select("id")
    assert ft.sample_authors(copies, 8).count() == 8


def test_words_meet_the_word_table_once_per_part(spark, lexicon, request):
    """Many small parts, an author above a part's size, null and repeated ids, texts without words."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    request.addfinalizer(lambda old=spark.conf.get(key): spark.conf.set(key, old))
    spark.conf.set(key, "400b")
    draw = random.Random(5)
    pool = ["good", "bad", "fair", "Good", "so", "so so", "  ", "x\x1cy", None]
    rows = [(draw.choice([1, 1, 1, 2, 3, 4]), i % 40 if i % 7 else None, T0, draw.choice(
        [None, "", " \t"]) if i % 11 == 0 else " ".join(filter(None, draw.choices(pool, k=draw.randint(1, 9))))) for i in range(120)]
    rows.append((5, 500, T0, None))
    df = spark.createDataFrame([(c, a, t, x, 2024) for a, c, t, x in rows], SCHEMA).repartition(4)
    value = {"good": 1.0, "bad": -1.0, "fair": 0.5}
    words_of, found = {}, {}
    for a, c, _, x in rows:
        words_of.setdefault(a, []).extend((x or "").split())
        found.setdefault((a, c), []).extend(value[w] for w in (x or "").lower().split() if w in value)
    n = {a: sum(r[0] == a for r in rows) for a in words_of}
    want = {a: (len(set(ws)) / len(ws) if ws else 0.0, sum(
        sum(v) / len(v) for (b, _), v in found.items() if b == a and v) / n[a], len({r[3] or "" for r in rows if r[0] == a}))
        for a, ws in words_of.items()}
    variety = {r["author_id"]: (r["distinct_words"], r["n_words"], r["n_texts"]) for r in ft._variety(df).collect()}
    assert variety == {a: (len(set(ws)), len(ws), want[a][2]) for a, ws in words_of.items()}
    diverse = {r["author_id"]: r["lexical_diversity"] for r in ft.lexical_diversity(df).collect()}
    polar = ft.sentiment_polarity(df, lexicon)
    assert diverse == {a: w[0] for a, w in want.items()}
    assert {r["author_id"]: r["sentiment_polarity"] for r in polar.collect()} == pytest.approx({a: w[1] for a, w in want.items()})
    # No plan has a row for every occurrence of a word.
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (polar, ft.lexical_diversity(df))]
    assert not any("Generate" in p for p in plans)


def test_comments_are_stored_without_their_texts(spark, monkeypatch):
    from palaver import fixtures as fx
    from palaver.registry import QUERIES

    kept = []
    monkeypatch.setattr(fx, "stage", lambda df, *a, **o: kept.append(df.columns) or df)
    monkeypatch.setattr(fx, "_stored", {})
    sf_dir = "/root/testdata/sf0.001"
    for name in ("thread_depth", "comment_gaps", "comments_per_day", "hour_entropy", "union_years", "corpus_counts", "comments_by_year",
                 "load_markers"):
        QUERIES[name](spark, sf_dir)
    assert kept == [[c for c in fx.comments(spark, sf_dir).columns if c != "content"]]
    plan = fx.comments(spark, sf_dir).select("comment_id", "author_id")._jdf.queryExecution().executedPlan().toString()
    assert "doc_id:" in plan and "text:" not in plan


def test_no_text_is_shuffled_and_any_guess_of_common_words_will_do(spark, lexicon, request, monkeypatch):
    """Few common words, small runs, values that don't fit, an author above a part's size."""
    from palaver.operators import wording

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    request.addfinalizer(lambda old=spark.conf.get(key): spark.conf.set(key, old))
    draw = random.Random(7)
    pool = ["good", "bad", "Fair", "bär", "x", "X", *(f"w{i}" for i in range(400))]
    rows = [(draw.choice([1, 1, 2, 3]), i, T0, " ".join(draw.choices(pool, k=draw.randint(0, 60)))) for i in range(200)]
    df = spark.createDataFrame([(c, a, t, x, 2024) for a, c, t, x in rows], SCHEMA).repartition(3)
    value = {"good": 1.0, "bad": -1.0, "fair": 0.5}
    want, polar = {}, {}
    for a, _, _, x in rows:
        want.setdefault(a, []).extend(x.split())
        hits = [value[w] for w in x.lower().split() if w in value]
        polar.setdefault(a, []).append(sum(hits) / len(hits) if hits else 0.0)
    texts = {a: len({r[3] for r in rows if r[0] == a}) for a in want}
    for common, part in ((1 << 18, "64m"), (2, "64m"), (300, "8k"), (0, "8k")):
        monkeypatch.setattr(wording, "_COMMON", common)
        monkeypatch.setattr(wording, "_FACTS", 150)
        spark.conf.set(key, part)
        variety = ft._variety(df)
        assert {r["author_id"]: (r["distinct_words"], r["n_words"], r["n_texts"]) for r in variety.collect()} == {
            a: (len(set(ws)), len(ws), texts[a]) for a, ws in want.items()}
        mood = ft.sentiment_polarity(df, lexicon)
        assert {r["author_id"]: r["sentiment_polarity"] for r in mood.collect()} == pytest.approx({a: sum(p) / len(p) for a, p in polar.items()})
        plan = variety._jdf.queryExecution().optimizedPlan().toString()
        dealt = re.findall(r"(?:RepartitionByExpression|RebalancePartitions).*\n[\s:]*\+- (.*)", plan)
        assert dealt and not any("content" in below for below in dealt if "MapInArrow" not in below), plan


def shuffle_files(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {name for folder in folders for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}


def test_stage_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    stored = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert sorted(r["count"] for r in stored.collect()) == [142] * 1 + [143] * 6


def test_feature_tables_are_stored_one_by_one(spark, lexicon):
    folder = work_dir(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    ft.author_features(frame(spark, [(1, at(0), "good"), (2, at(1), "bad")]), lexicon)
    new = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert {"activity", "variety", "polarity", "burstiness"} <= new


def test_texts_are_read_once_for_all_features(spark, lexicon, monkeypatch):
    """A survey and one cut into words: no other stored table looks at a text."""
    from palaver.operators import wording

    plans = {}

    def watched(df, name="stage", *a, **o):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stage(df, name, *a, **o)

    rows = [(i % 4, at(i), t) for i, t in enumerate(["good HTTP://x", None, "so bad", " hTTp", "http", "ht tp", "", "Good a\u00a0b"])]
    df = frame(spark, rows)
    for module in (wording, ft, timeline):
        monkeypatch.setattr(module, "stage", watched)
    got = {r["author_id"]: r["link_ratio"] for r in ft.author_features(df, lexicon).collect()}
    assert got == {r["author_id"]: r["link_ratio"] for r in ft.link_ratio(df).collect()} == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.5}
    sent = {name for name, plan in plans.items() if re.search(r"MapInArrow [^(]*\([^)]*\b(content|text)#", plan)}
    assert sent == {"survey", "words"} and "lower(content" not in plans["activity"]


def test_words_are_cut_coded_and_packed_exactly():
    import numpy as np
    import pyarrow as pa
    from palaver.operators import wording

    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [None, "", " ", "a", *(f"{s}x{s}{s}yz{s}" for s in spaces), "a\u200bb \u0000 \u0000b", "\ufeffq q q"]
    words, word, row = wording._cut(pa.array(texts, pa.string()))
    cut = [[] for _ in texts]
    for w, r in zip(word, row):
        cut[r].append(words[int(w)].as_py())
    assert cut == [(t or "").split() for t in texts]
    # Long words that differ in the middle only share a place: one is common there, none is taken for another.
    common = ["", "b", "\u0000", "b\u0000", *("12345678" + m + "abcdefgh" for m in "xyz"), *(f"w{i}" for i in range(3000))]
    known = wording.Known.of(pa.array(common), np.zeros(len(common), bool), np.zeros(len(common)))
    for some in (common, ["nothing", "12345678qabcdefgh", "\u0000\u0000", *common[::-1]]):
        found = known.codes(pa.array(some))
        assert all(c == -1 or common[c] == w for c, w in zip(found, some))
        assert np.mean(found >= 0) > 0.9 and (found[[some.index(w) for w in common[4:7]]] >= 0).sum() == 1
    groups = [[], [0], [5, 127, 128, 300, 1 << 14, (1 << 21) - 1], [], [7, 8], [0, 1 << 19]]
    flat = [(g, c) for g, codes in enumerate(groups) for c in codes]
    packed = wording._packed(*(np.array(column) for column in zip(*flat)), len(groups))
    for begin, end in ((0, 6), (2, 5), (3, 4)):
        codes, bounds = wording._unpacked(packed[begin:end])
        assert [codes[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == groups[begin:end]


def test_an_author_spans_tables_of_compacted_rows(spark, lexicon, monkeypatch):
    """Rows of an author that fill several tables meet once; tables of one row, and of all rows."""
    import pyarrow as pa
    from palaver.operators import wording

    rows = [{"author_id": a, "n_words": 2, "n_links": 1, "codes": bytes([c]), "rest": rest, "marks": mark}
            for a, c, rest, mark in [(1, 3, "x", "m"), (1, 3, "x\ny", "m"), (1, 4, "", "n"), (2, 9, "", "m"), (3, 1, "z", "m\nn"), (3, 1, "z", "m"), (3, 2, "", "o")]]
    batch = pa.RecordBatch.from_pylist(rows)
    for size in (1, 60, 1 << 20):
        monkeypatch.setattr(wording, "_CUT", size)
        got = [r for b in wording._varied(iter(batch.slice(i, 3) for i in range(0, 7, 3))) for r in b.to_pylist()]
        assert [tuple(r.values()) for r in got] == [(1, 2, 4, 6, 3), (2, 1, 1, 2, 1), (3, 3, 3, 6, 3)]


def test_the_lexicon_has_every_word_of_the_documents(spark, tmp_path):
    from palaver import fixtures as fx

    texts = [None, "", "  ", "One one\tTWO\u00a0x\u000bthree\u001cfour\r\n", "\u039f\u03a3 \u039f\u03a3. \u0130", "one ONE"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = spark.read.parquet(str(tmp_path / "documents.parquet")).select(
        F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''").distinct()
    got = [tuple(r) for r in fx.lexicon(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((r["word"], (len(r["word"]) % 5 - 2) / 2) for r in want.collect())
