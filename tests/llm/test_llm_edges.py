"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from palaver.llm import (  # noqa: E402
    bpe_automaton, cross_polytope, graph, hashing, html_extract, license_scan, ngram_join, packing, quality_rules, recompression, suffix_dedup, token_counts)

COLUMNS = "doc_id long, text string, words string, node long, token long, spans string, row_key long, n long, file int, kept string"
rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(300, 1)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE + " tail"), (3, BASE + " tail"), (None, BASE), (None, None), (4, None), (5, ""), (6, " \n\t "),
    (7, "one two"), (8, "ONE Two"), (9, prose(30, 5) + " " + " ".join(BASE.split()[100:170]) + " " + prose(30, 6)),
    (10, "a " * 3000), (11, "x" * 5000), (12, "same line here\n" * 200), (13, "# $ % & | < >\n" * 30), (14, prose(20000, 7)),
    (15, "Licensed under the Apache License, Version 2.0. MIT License and gnu General PUBLIC license; CC-BY 4.0"),
    (16, "<|endoftext|> ΣΑΣ İstanbul café 日本語 \x1c\x85\xa0 ½² 😀😀 don't"), (17, BASE.upper()),
    (18, "é" * 120 + BASE[:150]), (19, "é" * 121 + BASE[:150]),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("w", 1, 2, "s", 3, 4, 5, "k")
    return spark.createDataFrame([(*r, *extra) for r in ROWS], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


def values(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


def test_quality(docs, no_docs):
    got = values(quality_rules.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == ordered((d, *brute.quality(t)) for d, t in ROWS)
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_ablations(docs):
    entries = quality_rules.ledger(docs)
    bits = [r["failed_bits"] for r in entries.collect()]
    names = [r.name for r in quality_rules.RULES]
    for r in quality_rules.ablations(entries).collect():
        mask = quality_rules.mask_of(quality_rules.POLICIES[r["policy"], r["version"]])
        bit = 1 << names.index(r["rule"])
        assert r["n_failing"] == sum(b & bit > 0 for b in bits)
        assert r["n_regained"] == sum(b & mask == bit for b in bits)


def test_licenses(docs, no_docs):
    got = values(license_scan.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == ordered((d, *brute.licenses(t)) for d, t in ROWS)
    row = license_scan.scan(docs).filter("doc_id = 15").first()
    assert {"apache", "apache-2.0", "cc-by", "gpl", "mit"} <= set(row["labels"].split(",")) and row["score"] == 1.0
    assert license_scan.scan(no_docs).count() == 0


def test_packing(docs, no_docs):
    from test_llm_queries import check_packing
    rows = packing.pack_documents(docs).collect()
    assert ordered(tuple(r)[:5] for r in rows) == ordered(brute.pieces(ROWS))
    check_packing([r for r in rows if False], [])
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("low, high, n", [(1, 1024, 3000), (300, 600, 3000), (341, 342, 1000), (1024, 1024, 7), (1, 1, 5000)])
def test_plan_holds_every_piece(low, high, n):
    counts = np.bincount(np.random.default_rng(0).integers(low, high + 1, n), minlength=1025)
    held = np.zeros(1025, int)
    for pattern, times in packing.plan(counts):
        assert sum(length * k for length, k in pattern) <= 1024
        for length, k in pattern:
            held[length] += k * times
    assert (held == counts).all()


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffixes(docs, no_docs, hot):
    assert values(suffix_dedup.dedup(docs, hot=hot)) == ordered(brute.repeats(ROWS))
    assert suffix_dedup.dedup(no_docs).count() == 0


def test_suffixes_across_small_groups(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 2)
    assert values(suffix_dedup.dedup(docs)) == ordered(brute.repeats(ROWS))


def test_automaton(docs, no_docs):
    path = bpe_automaton.tokenizer_path("word_bpe_49k.json")
    assert values(bpe_automaton.encode_decode(docs, path)) == ordered(brute.encoded(ROWS))
    assert bpe_automaton.encode_decode(no_docs, path).count() == 0


def test_automaton_on_random_words():
    words = bpe_automaton.codec(bpe_automaton.tokenizer_path("word_bpe_49k.json"))
    want = brute.tokenizer("word_bpe_49k.json")
    r = random.Random(9)
    for _ in range(3000):
        text = "".join(r.choice("aaabcdehilnoorst'0!é中😀") for _ in range(r.randrange(1, 40)))
        ids = want.encode(text, add_special_tokens=False).ids
        assert words.encode(text) == ids and words.decode(ids) == want.decode(ids, skip_special_tokens=False)


def test_recompression(docs, no_docs):
    assert values(recompression.dedup(docs)) == ordered(brute.passages(ROWS))
    assert recompression.dedup(no_docs).count() == 0


def test_recompression_of_runs(spark):
    r = random.Random(5)
    base = ["a"] * 120 + ["b", "b", "c"] * 30 + [r.choice("abc") for _ in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(["x"] * 3 + base[10:200] + ["y"])), (3, " ".join(["a"] * 75)), (4, " ".join(base[200:260] + ["a"] * 5)),
            (5, " ".join(base[:49])), (6, " ".join(["b", "b", "c"] * 25))]
    assert values(recompression.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == ordered(brute.passages(rows))


def test_join(docs, no_docs):
    got = values(ngram_join.link_classes(docs))
    unknown = [(None, len(s)) for s in (set(zip(*[BASE.split()[i:] for i in range(5)])), set())]
    assert [g for g in got if g[0] is not None] == ordered(x for x in brute.link_classes([r for r in ROWS if r[0] is not None]))
    assert [g[:2] for g in got if g[0] is None] == ordered(unknown) and all(g[2] is None for g in got if g[0] is None)
    assert ngram_join.link_classes(no_docs).count() == 0


@pytest.mark.parametrize("rare", [ngram_join.RARE, 0])
def test_join_of_chains(spark, monkeypatch, rare):
    """Links that lead from text to text, with shared passages, and every bucket frequent or rare."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    r = random.Random(2)
    passage, rows = prose(40, 77).split(), []
    for group in range(12):
        text = prose(100, 100 + group).split()
        for step in range(8):
            rows.append((len(rows) * 7 % 101, " ".join(text + passage)))
            for _ in range(2):
                text[r.randrange(len(text))] = r.choice(VOCABULARY)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert values(ngram_join.link_classes(df)) == ordered(brute.link_classes(rows))


def edited(r, text, edits):
    text = list(text)
    for _ in range(edits):
        text[r.randrange(len(text))] = r.choice(VOCABULARY)
    return text[r.randrange(12):len(text) - r.randrange(12)]


@pytest.mark.parametrize("rare, crowd", [(ngram_join.RARE, ngram_join.CROWDED), (0, 0)])
def test_join_near_the_threshold(spark, monkeypatch, rare, crowd):
    """Copies with so many edits that about as many pairs miss the threshold as reach it: hardly a pair that misses
    it is looked at, none that reaches it is lost."""
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "CROWDED", crowd)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    looked, whole = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda docs, pairs, *more: looked.append(pairs.count()) or whole(docs, pairs, *more))
    r, rows = random.Random(4), []
    for group in range(3):
        text = prose(300, 200 + group).split()
        rows += [(len(rows) + i, " ".join(edited(r, text, r.randrange(5, 22)))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = ordered(brute.link_classes(rows))
    assert values(ngram_join.link_classes(df)) == want and len({c for _, _, c in want}) > 6
    assert len(looked) == (3 if crowd == 0 else 2) and sum(looked[1:]) < 200  # of about 900 pairs


def test_least_common(spark):
    """Sets that just reach the threshold share as much as is asked of their extended prefixes, whatever the order."""
    r, cases = random.Random(6), []
    for n in (1, 5, 30, 43, 60, 200, 400):
        for m in sorted({n, n + n // 10, n + n // 4, n + n // 3}):
            shared = -(-75 * (n + m) // 175)
            for low in range(3):  # those that only one set has come first, last or anywhere
                if shared <= n:
                    order = r.sample(range(n + m - shared), n + m - shared)
                    if low < 2:
                        order.sort(reverse=low == 1)
                    common = set(order[:shared] if low else order[-shared:])
                    alone = [x for x in order if x not in common]
                    sets = [sorted(common | set(alone[:n - shared])), sorted(common | set(alone[n - shared:]))]
                    ends = [x[:ngram_join.prefix_size(len(x)) + ngram_join.COMMON - 1] for x in sets]
                    cases.append((n, m, len(set(ends[0]) & set(ends[1]))))
    asked = spark.createDataFrame(cases, "n long, m long, both long").withColumn("least", ngram_join.least_common("n", "m")).collect()
    assert len(asked) > 60 and all(x["both"] >= x["least"] for x in asked)
    assert [x["least"] for x in asked if x["n"] == x["m"] == 400] == [75] * 3


def test_one_of_each(spark, docs):
    kept = values(ngram_join.one_of_each(spark, docs, ""), "doc_id", "text")
    want = {}
    classes = {d: c for d, _, c in brute.link_classes([r for r in ROWS if r[0] is not None])}
    for d, t in ROWS:
        if d is not None and classes[d] == d:
            want[d] = t
    assert kept == ordered([*want.items(), *[r for r in ROWS if r[0] is None]])


def test_one_of_each_of_clashing_ids(spark):
    alone = [prose(120, seed) for seed in range(50, 56)]
    copy = BASE + " tail"
    want = [(1, BASE), (5, alone[0]), (5, alone[1]), (6, alone[2]), (8, ""), (8, " \n"), (8, None), (9, alone[4])]
    rows = [*want, (5, copy), (5, alone[0]), (6, alone[2]), (8, ""), (8, None), (9, alone[1]), (9, alone[4] + " more")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = values(ngram_join.one_of_each(spark, df, ""), "doc_id", "text")
    smaller = min((alone[4], alone[4] + " more"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert got == ordered([*want[:-1], (9, smaller)])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket int, query_id long, score double")


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 1.0, float(i)]) for i in range(12)]
    rows += [(12, [1.0, 2.0, 3.0]), (12, [1.0, 2.0, 3.0]), (20, None), (40, [0.0, 0.0, 0.0]), (60, [nan, 1.0, 1.0]), (80, [inf, 1.0, 1.0]),
             (100, [1.0, None, 2.0]), (120, [1.0, 2.0]), (140, [2.0, 0.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = vectors(spark, [(*r, 1, 2, 3.0) for r in rows])
    got = {}
    for r in cross_polytope.search(df, "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    known = {i: v for i, v in rows if i is not None and (i <= 12 or i == 140)}
    for q in (0, 140):
        want = sorted(((sum(a * b for a, b in zip(known[q], v)), i) for i, v in known.items() if i != q), key=lambda p: (-p[0], p[1]))[:20]
        assert sorted(got[q]) == [(k + 1, i, s) for k, (s, i) in enumerate(want)]
    assert set(got) == {0, 140}
    assert cross_polytope.search(vectors(spark, []), "vec_id % 20 = 0").count() == 0


def test_search_of_hot_and_uneven_vectors(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "BLOCK", 50)
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 16)) * r.uniform(0.5, 3, (600, 1))
    x[:200] = x[0]
    x = x.astype(np.float32).astype(float)
    df = vectors(spark, [(i, v.tolist(), 1, 2, 3.0) for i, v in enumerate(x)])
    found = {}
    for row in cross_polytope.search(df, "vec_id % 20 = 0").collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"]))
    hits = 0
    for q in range(0, 600, 20):
        score = np.array([(x[q] * v).sum() for v in x])
        want = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        assert len(found[q]) == 20
        hits += len(set(want) & {v for _, v in found[q]})
    assert hits >= 0.9 * 20 * 30


@pytest.mark.parametrize("norms", ["one long", "log-normal"])
def test_search_of_unlike_norms(spark, monkeypatch, norms):
    monkeypatch.setattr(cross_polytope, "BLOCK", 30)
    pdf = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("vec_id < 2000").toPandas().sort_values("vec_id")
    x = np.array(pdf["embedding"].tolist(), float)
    x = x * np.random.default_rng(0).lognormal(size=(len(x), 1)) if norms == "log-normal" else x
    x[7] *= 5 if norms == "one long" else 1
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for row in cross_polytope.search(df, "vec_id % 20 = 0").collect():
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    queries = range(0, len(x), 20)
    wanted = [set([i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]) for q in queries]
    assert sum(len(found[q] & w) for q, w in zip(queries, wanted)) >= 0.95 * 20 * len(wanted)


@pytest.mark.parametrize("block", [40, cross_polytope.BLOCK])
def test_search_of_repeated_ids(spark, monkeypatch, block):
    monkeypatch.setattr(cross_polytope, "BLOCK", block)
    r = np.random.default_rng(6)
    center = r.normal(size=16)
    near = lambda n: center + 0.05 * r.normal(size=(n, 16))
    rows = [(i, v) for i, v in enumerate(near(60)) for _ in range(30)]  # a tight cluster, every row repeated
    rows += [(100, v) for v in 1.05 * near(100)] + [(101, 1.1 * center)] * 100
    rows = [(i, v / np.linalg.norm(v)) for i, v in rows]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for row in cross_polytope.search(df, "vec_id % 20 = 0").collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"]))
    for q in (0, 20, 40, 100):
        score = {}
        for mine in {tuple(v) for i, v in rows if i == q}:
            for i, v in rows:
                if i != q:
                    score[i] = max(score.get(i, -9), (np.array(mine) * v).sum())
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [v for _, v in sorted(found[q])] == want


def test_counts(docs, no_docs):
    for size in (7, token_counts.BLOCK):
        blocks, order = token_counts.write_flat(docs, block=size)
        got = order.join(token_counts.count_tokens(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")
        assert values(got) == ordered(brute.token_counts(ROWS))
    blocks, order = token_counts.write_flat(no_docs)
    assert token_counts.count_tokens(blocks).count() == 0


def test_counts_of_an_unfinished_file(spark):
    ids = np.array([1, 2, 50256, 50256, 7, 8, 9], "<u2")
    df = spark.createDataFrame([(0, i, ids[2 * i:2 * i + 2].tobytes()) for i in range(4)], "file int, block long, data binary")
    assert values(token_counts.count_tokens(df)) == [(0, 0, 2), (0, 1, 0), (0, 2, 3)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar">
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies here</div>
<main><article><header><h1>Big &amp; bold</h1></header><p>First <b>para</b>graph&nbsp;one<br>two<p>Second <a href="x">link</a>.<aside>Related stuff</aside>
<form><label>Name</label><input></form><!-- hidden <p>no</p> --><div id="ad-slot">Buy!</div><p>Last</p></article>
<section class="comments"><article><p>Nice post, dear author, thank you so much</p></article></section></main><footer>&copy; me</footer>"""


def test_page_by_hand(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "v", "<p>" + "word " * 60 + "<p>" + "more " * 40), (4, "u", PAGE[:PAGE.index("Second") + 6]), (1, "u", PAGE)]
    df = spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[1] == "Big & bold First paragraph one two Second link. Last"
    assert got[2] == got[3] == ""
    assert got[None] == ("word " * 60 + "more " * 40).strip()
    assert got[4] == "Big & bold First paragraph one two Second"
    assert html_extract.extract(df).count() == len(rows) and html_extract.extract(df.limit(0)).count() == 0


TEXT, NAV, FOOT = prose(90, 30), '<nav><a href="/a">Menu</a></nav>', "<footer>Copyright by us</footer>"


@pytest.mark.parametrize("page", [
    f'<form id="aspnetForm">{NAV}<main><p>{TEXT}</p></main>{FOOT}</form>',
    f'<form id="aspnetForm">{NAV}<div><p>{TEXT}</p></div>{FOOT}</form>',
    f'{NAV}<div class="layout-sidebar-right"><article><p>{TEXT}</p></article><aside>Other things</aside></div>{FOOT}',
    f'{NAV}<div class="page-with-sidebar"><main><p>{TEXT}</p></main></div>{FOOT}',
    f'{NAV}<div class="content-notification-wrap"><article><p>{TEXT}</p></article></div>{FOOT}',
    f'{NAV}<div id="text"><p>{TEXT}</p></div><article class="card"><a href="/b">Read more</a></article>{FOOT}',
    f'{NAV}<div class="page-with-sidebar"><div><p>{TEXT}</p></div><article><a href="/b">Read this too</a> now</article></div>{FOOT}',
    f'{NAV}<article><p>{TEXT}</p></article><section class="comments"><article>{prose(200, 31)}</article></section>{FOOT}',
])
def test_text_of_wrapped_pages(page):
    assert html_extract.main_text(page, html_extract.grow(list(html_extract.BLOCKS))) == TEXT


@pytest.mark.parametrize("start", [
    '<svg class="icon"/>', '<svg class="icon" />', "<svg><title>t</title><text>icon</text></svg>", "<object data=x>", "<svg class=icon>",
    "<select><option>One<option>Two", "<select><optgroup label=a><option>One</option></optgroup>", "<select><option>One<option>Two</select>",
    "<object data=x><p>no plugin</p></object>", "<span><object></span>"])
def test_foreign_elements(start):
    page = f"{NAV}<article>{start}<p>{TEXT}</p></article>{FOOT}"
    assert html_extract.main_text(page, html_extract.grow(list(html_extract.BLOCKS))) == TEXT


def test_stages_on_edges(spark, docs, no_docs):
    for frame in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, "")
            assert frame.columns == docs.columns
            frame = spark.createDataFrame(frame.collect(), frame.schema)
        corpus_pipeline.STAGES[-1][1](spark, frame, "").collect()
    assert suffix_dedup.without_repeats(spark, docs, "").filter(F.col("text").isNull()).count() == 2


def test_repeats_that_split_characters(spark):
    w, x, y, z = (random.Random(seed).randbytes(110).hex() for seed in range(4))
    rows = [(1, f"one {w}é"), (2, f"two {w}è"), (3, f"😀{x} three"), (4, f"🤀{x} four"), (5, f"5 {y}日 five"), (6, f"6 {y}旦 six"),
            (7, f"😀{z}é"), (8, f"🤀{z}è"), (9, None)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars int")
    count = Counter(w for _, t in rows for w in windows(t))
    want = []
    for i, t in rows:
        raw, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for at, w in enumerate(windows(t)):
            if count[w] > 1:
                gone[at:at + 200] = b"\1" * 200
        text = None if t is None else bytes(b for b, g in zip(raw, gone) if not g).decode(errors="replace")
        want.append((i, text, None if text is None else len(text)))
    assert sum("\ufffd" in (t or "") for _, t, _ in want) == 6
    got = suffix_dedup.without_repeats(spark, df, "")
    assert got.schema["n_chars"].dataType == df.schema["n_chars"].dataType and values(got) == ordered(want)


def windows(text, length=200):
    raw = (text or "").encode()
    return [raw[i:i + length] for i in range(len(raw) - length + 1)]


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    """Two words of 2,048 letters that agree modulo a power of 2: nothing repeats, nothing links."""
    filler = [f"w{i}" for i in range(60)]
    texts = [" ".join(filler[:30] + [thue_morse(2048, flip)] + filler[30:]) for flip in (False, True)]
    df = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, thue_morse(2048)), (4, thue_morse(2048, True))], "doc_id bigint, text string")
    for lower in (False, True):
        data = "".join(texts[:2]).encode()
        hashes, *_ = hashing.words(np.frombuffer(data, np.uint8), np.array([0, len(texts[0]), len(data)]), lower)
        assert len(set(hashes.tolist())) == 62
    assert {r["doc_id"]: r["n_removed"] for r in recompression.dedup(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    linked = {r["doc_id"]: r["component_id"] for r in ngram_join.link_classes(df).collect()}
    assert linked[3] == 3 and linked[4] == 4
    raw = (thue_morse(2048) + thue_morse(2048, True)).encode()
    keys = suffix_dedup.row_keys(np.frombuffer(raw, np.uint8), np.array([0, 2048, 4096]), np.array([1, 1]), np.array([True, True]))
    assert keys[0] != keys[1]


def test_the_table_of_pieces_stays_small(monkeypatch):
    from palaver.llm import byte_tokens as bt

    assert bt.KEPT_PIECES <= 1 << 17
    tokens, text = bt.ByteTokens(True), " ".join(f"w{i}x" for i in range(500)) + bt.END + " end"
    whole = tokens.encode(text)
    monkeypatch.setattr(bt, "KEPT_PIECES", 50)
    tokens.pieces.clear()
    assert tokens.encode(text) == whole and len(tokens.pieces) <= 50


def test_bitmaps_leave_the_disk(spark):
    """What tasks got to know is dropped as soon as what they made with it is stored."""
    docs = spark.createDataFrame([(i, prose(90, i % 4) + f" {i % 3}") for i in range(12)], "doc_id long, text string")
    folder = spark.sparkContext._temp_dir
    before = set(os.listdir(folder))
    classes = ngram_join.set_classes(docs)
    spans = suffix_dedup.removed_spans(docs)
    assert set(os.listdir(folder)) <= before
    assert classes.count() == 12 and spans.count()


def test_bitmap_comes_in_few_jobs(spark):
    keys = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    context = spark.sparkContext
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        context.setJobGroup("bits", "bits")
        bits = graph.bitmap(spark.range(5000), "id")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(context.statusTracker().getJobIdsForGroup("bits")) < 40
    assert hashing.set_bit(bits, np.arange(5000, dtype=np.uint64)).all()
