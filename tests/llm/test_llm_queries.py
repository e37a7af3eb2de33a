"""The queries over the smallest tables, against check SQL or brute force."""

import os
import sys

import numpy as np
import pytest

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import oracle_check  # noqa: E402
from palaver.llm.registry import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


def results(spark, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, SF_DIR).select(*columns).collect())


@pytest.mark.parametrize("name", list(ORACLES))
def test_check_sql(spark, name):
    assert oracle_check.compare(spark, oracle_check.connect(SF_DIR), QUERIES[name], ORACLES[name], SF_DIR) == ""


def test_quality_rules(spark, rows):
    got = results(spark, "op1_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted((d, *brute.quality(t)) for d, t in rows)


def test_license_scan(spark, rows):
    got = results(spark, "op3_license_scan", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted((d, *brute.licenses(t)) for d, t in rows)


def check_packing(packed, want):
    assert sorted(tuple(r)[:5] for r in packed) == sorted(want)
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    least = -(-sum(p[3] for p in want) // 1024)
    assert len(sequences) <= 1.05 * least + 5


def test_packing(spark, rows):
    check_packing(QUERIES["op2_best_fit_packing"](spark, SF_DIR).collect(), brute.pieces(rows))


@pytest.mark.parametrize("name, contract", [
    ("op4_suffix_dedup", brute.repeats), ("op5_bpe_automaton", brute.encoded), ("op6_recompression", brute.passages),
    ("op7_ngram_join", brute.link_classes), ("op9_token_counts", brute.token_counts)])
def test_against_brute_force(spark, rows, name, contract):
    assert sorted(map(tuple, QUERIES[name](spark, SF_DIR).collect())) == sorted(contract(rows))


def test_recall(spark):
    pdf = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").toPandas()
    x, ids = np.array(pdf["embedding"].tolist(), float), pdf["vec_id"].to_numpy()
    found, wanted = {}, {}
    for r in QUERIES["op8_cross_polytope"](spark, SF_DIR).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:20]
        wanted[ids[i]] = {ids[j] for j in order}
        got = found[ids[i]]
        assert sorted(got) == list(range(1, 21))
        at = {v: k for k, v in enumerate(ids)}
        assert all(abs(score[at[v]] - s) < 1e-12 for v, s in got.values())
        assert [v for _, v in sorted(got.items())] == sorted(got.values(), key=lambda p: (-p[1], p[0]))
    assert wanted.keys() == found.keys()
    hits = sum(len(wanted[q] & {v for v, _ in found[q].values()}) for q in wanted)
    assert hits >= 0.9 * 20 * len(wanted)


def test_pages(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in QUERIES["op10_html_extract"](spark, SF_DIR).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        article = re.sub(r"</?b>", "", re.sub(r"<(p|/p|h1|/h1|br)>", " ", article))
        assert r["text"] == " ".join(html.unescape(article).split())
        assert r["n_chars"] == len(r["text"])


def test_pipeline(spark, rows):
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    good = [(d, t) for d, t in rows if keeps(t)]
    chosen = {c for _, _, c in brute.link_classes(good)}
    single = [(d, t) for d, t in good if d in chosen]
    cut = []
    from collections import Counter
    count = Counter()
    for _, t in single:
        raw = t.encode()
        count.update(raw[i:i + 200] for i in range(len(raw) - 199))
    for d, t in single:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if count[raw[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        cut.append((d, bytes(b for b, g in zip(raw, gone) if not g).decode(errors="replace")))
    check_packing(got, brute.pieces(cut))


def keeps(text):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = brute.quality(text)
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return not (n_words < 50 or 100 * n_repeat > 50 * n_words or n_symbols > n_words or word_chars > 40 * n_words or 2 * n_dup_lines > len(lines))


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns


def test_quality_stage_plan(spark, rows):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SF_DIR)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(d for d, t in rows if keeps(t))
