"""The manifest, the rule ensemble and the collocations: edge cases and brute force."""

import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]

import brute  # noqa: E402
from palaver.llm import collocations, merkle, rule_ensemble  # noqa: E402
from palaver.llm.registry import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, extra=False):
    """Rows of (doc_id, text, lang, source, n_chars), with columns of clashing names if asked for."""
    df = spark.createDataFrame(rows, DOCS)
    for name in ("tree", "pos", "leaf", "w1", "id", "words", "score", "n", "label", "quality") if extra else ():
        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [(None, "no id", "en", "s", 3), (7, None, None, None, None), (7, None, None, None, None), (3, "", "", "s", 0),
       (5, "same", "en", "a", 4), (5, "other", "en", "a", 5), (9, "Z" * 300_000 + " ünï 漢", "de", "ü", 2**63 - 1)]


# ---- manifest --------------------------------------------------------------------------


def manifest_rows(df):
    return sorted(map(tuple, merkle.merkle_manifest(df).collect()), key=str)


def wanted_manifest(df):
    return sorted(brute.manifest([r.asDict() for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]), key=str)


def test_manifest_of_the_table(spark):
    got = sorted(map(tuple, QUERIES["op11_merkle_manifest"](spark, SF_DIR).collect()), key=str)
    assert got == wanted_manifest(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("extra", [False, True])
def test_manifest_of_odd_rows(spark, extra):
    df = documents(spark, ODD, extra)
    assert manifest_rows(df) == wanted_manifest(df)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert manifest_rows(documents(spark, [])) == []
    one = documents(spark, [(1, "a", "en", "s", 1)])
    ((_, leaf, subroot, root, proof, folded, verified),) = manifest_rows(one)
    assert leaf == subroot == root == folded and verified
    assert manifest_rows(one) == wanted_manifest(one)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_of_several_rounds(spark, monkeypatch, levels):
    """Small blocks, so that paths go through several of them, with lone nodes at every height."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 1 << levels)
    rng = random.Random(levels)
    rows = [(i, f"text {rng.random()}", "en" if i < 37 else f"l{i % 6}", "s", i) for i in range(60)] + [(4, "copy", "en", "s", 1)] * 5
    df = documents(spark, rows)
    assert manifest_rows(df) == wanted_manifest(df)


def test_a_version_copies_ancestors_only(spark):
    rows = [(i, str(i), "en", "s", i) for i in range(300)]
    versions = merkle.manifest(documents(spark, rows)).leaves.select("doc_id", "tampered", F.size("version").alias("n"), F.size("path").alias("up"))
    for r in versions.collect():
        assert r["n"] == r["up"] + 1 == 10  # the leaf, nine levels, one language


# ---- rule ensemble ---------------------------------------------------------------------


def test_rules_tell_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = QUERIES["op12_quality_ensemble"](spark, sf)
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_held_out_labels_are_never_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lies = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    model = rule_ensemble.fit_quality(docs, labels)
    assert model == rule_ensemble.fit_quality(docs.repartition(5), lies)
    assert model == rule_ensemble.Ensemble.from_json(model.to_json())
    named = {statistic for rule, _ in model.rules for statistic, _, _ in rule.bounds}
    assert named <= set(rule_ensemble.STATISTICS)
    table, label, _ = rule_ensemble.training_table(docs, labels)
    assert len(label) == labels.where(~held).count()
    assert len(rule_ensemble.training_table(docs, labels, sample=50)[1]) == 50


def test_compiled_rules_score_like_the_model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bounds = (rule_ensemble.Rule((("n_words", True, 40.5), ("distinct_words", False, 0.75))), -2.5), (
        rule_ensemble.Rule((("symbols_per_word", True, 0.01),)), 1.25)
    model = rule_ensemble.Ensemble(0.5, bounds)
    rows = rule_ensemble.statistics(docs, "doc_id").withColumn("score", model.column()).toPandas()
    want = model.predict({n: rows[n].to_numpy() for n in rule_ensemble.STATISTICS})
    assert np.allclose(rows["score"], want) and len(set(np.round(want, 6))) > 2


def test_ensemble_on_odd_rows(spark):
    labels = "doc_id bigint, quality int, toxic int"
    docs = documents(spark, ODD, extra=True)
    none = rule_ensemble.fit_quality(docs, spark.createDataFrame([], labels))
    assert [r["score"] for r in rule_ensemble.quality_scores(docs, none).collect()] == [0.5] * len(ODD)
    known = spark.createDataFrame([(7, 1, 0), (7, None, 0), (None, 0, 0), (3, 1, 0), (9, 1, 1), (404, 0, 0)], labels)
    same = rule_ensemble.fit_quality(docs, known)
    scored = rule_ensemble.quality_scores(docs, same).collect()
    assert len(scored) == len(ODD) and {r["predicted"] for r in scored} == {1}
    assert [r["held_out"] for r in scored if r["doc_id"] is None] == [False]
    assert rule_ensemble.quality_scores(documents(spark, []), same).count() == 0


def test_trees_and_lasso_find_a_planted_rule():
    rng = np.random.default_rng(3)
    table = {"a": rng.random(600), "b": rng.random(600), "c": rng.random(600)}
    label = ((table["a"] > 0.6) & (table["b"] <= 0.5)).astype(float)
    model = rule_ensemble.fit(table, label, rng.random(600) < 0.2)
    assert ((model.predict(table) >= 0.5) == (label == 1)).mean() >= 0.98
    rules = rule_ensemble.grow_paths(table, label)
    assert 0 < len(model.rules) < len(rules)  # the penalty leaves most paths out
    assert len(rule_ensemble.fit({k: np.ones(40) for k in table}, label[:40], np.zeros(40, bool)).rules) == 0


# ---- collocations ----------------------------------------------------------------------


def phrase_rows(df, **options):
    return sorted(map(tuple, collocations.collocations(df, **options).collect()))


def wanted_phrases(df, **options):
    return brute.phrases([(r["lang"], r["text"]) for r in df.select("lang", "text").collect()], **options)


def made_up(seed, size, words=9):
    rng = random.Random(seed)
    vocabulary = ["aa", "Bb", "c-c", "ünï", "É", "x y", "d'd", "the", "漢字"][:words]
    gaps = [" ", "  ", "\t", " ", " ", ". ", "\n", "\v", "; "]
    return "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(size))


@pytest.mark.parametrize("extra", [False, True])
def test_phrases_of_odd_rows(spark, extra):
    rows = [(i, made_up(i, 150), ("en", "de", None, "und")[i % 4], "s", 1) for i in range(24)] + ODD
    rows += [(50, "tie one. " * 10 + "two ways. " * 10 + "a a a a " * 6, "fr", "s", 1)] * 2
    df = documents(spark, rows, extra)
    assert phrase_rows(df) == wanted_phrases(df)
    assert phrase_rows(df, top=3) == wanted_phrases(df, top=3)


def test_phrases_of_nothing(spark):
    assert phrase_rows(documents(spark, [])) == []
    assert phrase_rows(documents(spark, [(1, "", "en", "s", 0), (2, None, None, "s", 0), (3, "one two", "en", "s", 7)])) == []


def test_hot_stripes_are_cut_and_rows_of_a_stripe_are_short(spark, monkeypatch):
    """A prefix with a third of all words, runs of one text and rows of two entries."""
    monkeypatch.setattr(collocations, "LEAST_SHARE", 40)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "the", "the", *[f"w{i}" for i in range(12)]]) for _ in range(400)) for _ in range(8)]
    df = documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    vocabulary, _ = collocations.count_words(df)
    keys, parts = collocations._hot(vocabulary, "id", "n", 0)
    assert len(keys) and parts.max() > 5
    assert phrase_rows(df) == wanted_phrases(df)


def test_words_that_share_an_id_get_another_seed(spark, monkeypatch):
    made = collocations._per_run

    def colliding(docs, seed, function, schema):
        counted = made(docs, seed, function, schema)
        return counted.withColumn("id", F.lit(5).cast("long")) if seed == 0 else counted

    monkeypatch.setattr(collocations, "_per_run", colliding)
    words, seed = collocations.count_words(documents(spark, [(1, "one two " * 12, "en", "s", 1)]))
    assert seed == 1 and words.select("id").distinct().count() == 2


def test_words_of_a_run():
    data = np.frombuffer(b"One two one.TwoThree", np.uint8)
    run = collocations.Run(pa.array(["en", "de"]), data, np.array([0, 15, 20]), 0)
    assert sorted(zip(run.langs, run.words)) == [("de", b"three"), ("en", b"one"), ("en", b"two")]
    assert [run.words[i] for i in run.token] == [b"one", b"two", b"one", b"two", b"three"]
    assert run.joined.tolist() == [True, True, False, False, False]


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 9_999_999_999_999, 99_999_999_999_999, 10_000_000_000_001
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert row.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1000000 * a * a // (left * right)
