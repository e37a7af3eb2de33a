"""Phrase collocations by stripes.

A stripe belongs to a phrase of one or two words, its prefix, and counts the words that come next,
with one entry, OTHER, for those that cannot end a frequent phrase and for the end of a piece. Tasks
make the stripes of a run of texts, Spark brings those of a prefix together, and they are added
entry by entry. A stripe then says all that is asked: its total is the number of times its prefix
occurs, its entries are the prefix's extensions, and its largest entry is the most frequent phrase
that continues it. Two levels of stripes count phrases of up to three words; the second holds only
entries both of whose pairs the first has found to be frequent, which loses no frequent phrase.

A prefix with more than ``share`` occurrences has its stripe cut by the next word's hash into as
many parts as it has shares, so that no task gets one word's whole stripe. There are at most
HOT prefixes with that many, whatever the input.

Words are known by 64-bit hashes of language and word, drawn anew with another seed if two words
share one, so counts are exact. Null texts are empty, a null language is ``und``; null ids and
repeated rows count like any other; an empty table has no phrases. Only lang and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palaver.llm.common import documents, stage
from palaver.llm.graph import bitmap
from palaver.llm.hashing import mix, set_bit

#: Phrases with fewer occurrences are not looked at.
LEAST = 10
#: Phrases reported for a language.
TOP = 2000
#: A phrase goes if a longer one around it has at least this share of its occurrences, in percent.
SUBSUMED = 50
#: Prefixes whose stripes are cut, at most, and the least share of a part.
HOT = 1 << 16
LEAST_SHARE = 1 << 17
#: Bytes of text that are counted together, and entries in a row of a stripe.
RUN = 1 << 23
ENTRIES = 512

OTHER = 0
_WORD, _GAP, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _GAP
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_STRIPE = "w1 long, w2 long, part int, next array<long>, n array<int>"
_MERGED = "w1 long, w2 long, total long, best long, next array<long>, n array<long>, pair array<long>"


class Run:
    """The words of a run of texts as numbers: ``token[i]`` is the place of word i in ``ids``, and
    ``joined[i]`` says whether word i + 1 follows it in the same piece."""

    def __init__(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray, seed: int):
        kind = _KIND[data]
        word = kind == _WORD
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if len(data):
            starts = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]))
            ends = np.flatnonzero(word & np.concatenate([~word[1:] | edge[1:-1], [True]])) + 1
        else:
            starts = ends = np.empty(0, np.int64)
        row = np.searchsorted(offsets, starts, side="right") - 1
        self.joined = np.zeros(len(starts), bool)
        if len(starts):
            at = np.searchsorted(np.flatnonzero(kind == _BREAK), starts)
            self.joined[:-1] = (row[1:] == row[:-1]) & (at[1:] == at[:-1])
        places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        del starts, ends, kind, edge
        texts = pa.Array.from_buffers(
            pa.large_binary(), len(row), [None, pa.py_buffer(places), pa.py_buffer(_LOWER[data[word]])])
        words = texts.dictionary_encode()
        del texts, places, word
        lang = langs.dictionary_encode()
        size = max(len(words.dictionary), 1)
        code = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * size + words.indices.to_numpy(zero_copy_only=False)
        del row
        self.token, seen = pd.factorize(code)
        names = lang.dictionary.to_pylist()
        self.langs = [names[i] for i in seen // size]
        spelled = words.dictionary.to_pylist()
        self.words = [spelled[i] for i in seen % size]
        hashed = [xxhash.xxh3_64_intdigest(g.encode() + b"\t" + w, seed) or 1 for g, w in zip(self.langs, self.words)]
        self.ids = np.array(hashed, np.uint64).view(np.int64)


def runs(batch: pa.RecordBatch, seed: int) -> Iterator[Run]:
    """Runs of rows of about RUN bytes; a longer text is a run by itself."""
    texts = batch.column("text")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN, side="right")) - 1)
        yield Run(batch.column("lang").slice(first, last - first), data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], seed)
        first = last


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _per_run(docs: DataFrame, seed: int, function, schema: str) -> DataFrame:
    def work(batches):
        for batch in batches:
            for run in runs(batch, seed):
                if len(run.token):
                    yield from function(run)

    return _texts(docs).mapInArrow(work, schema)


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(id, lang, word, n) of every word of a language, and the seed of the ids."""

    def counted(run: Run):
        yield pa.RecordBatch.from_arrays([
            pa.array(run.ids), pa.array(run.langs, pa.string()), pa.array(run.words, pa.binary()).cast(pa.string()),
            pa.array(np.bincount(run.token, minlength=len(run.ids)).astype(np.int64))], ["id", "lang", "word", "n"])

    for seed in count():
        words = stage(_per_run(docs, seed, counted, "id long, lang string, word string, n long")
                      .groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            return words, seed


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64)) + b.view(np.uint64)).view(np.int64)


def _hot(prefixes: DataFrame, key: str, n: str, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the prefixes with more than a share of all words, at most HOT, and their parts."""
    share = max(LEAST_SHARE, total // HOT)
    rows = prefixes.where(F.col(n) > share).select(key, n).collect()
    keys = np.array([r[0] for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], np.array([-(-r[1] // share) for r in rows], np.int64)[order]


def _parts(hot: tuple[np.ndarray, np.ndarray], keys: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The part of its prefix's stripe to which each entry belongs."""
    known, parts = hot
    if not len(known):
        return np.zeros(len(keys), np.int32)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    n = np.where(known[at] == keys, parts[at], 1).astype(np.uint64)
    return (mix(following.view(np.uint64)) % n).astype(np.int32)


def _rows(w1: np.ndarray, w2: np.ndarray, group: np.ndarray, part: np.ndarray, following: np.ndarray, n: np.ndarray):
    """Stripes as rows of at most ENTRIES entries. Entries come in the order of ``group``."""
    if part.any():
        order = np.lexsort((part, group))
        w1, w2, group, part, following, n = (x[order] for x in (w1, w2, group, part, following, n))
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (part[1:] != part[:-1])])
    at = np.arange(len(group))
    begin = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % ENTRIES == 0))
    for low in range(0, len(begin), 1 << 16):
        b = begin[low:low + (1 << 16)]
        end = begin[low + (1 << 16)] if low + (1 << 16) < len(begin) else len(group)
        offsets = pa.array(np.append(b, end) - b[0], pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(w1[b]), pa.array(w2[b]), pa.array(part[b]),
            pa.ListArray.from_arrays(offsets, pa.array(following[b[0]:end])),
            pa.ListArray.from_arrays(offsets, pa.array(n[b[0]:end].astype(np.int32)))], ["w1", "w2", "part", "next", "n"])


def _counted(prefix: np.ndarray, following: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (prefix, following) in order, and how often each stands there."""
    codes, n = np.unique(prefix.astype(np.int64) * size + following, return_counts=True)
    return codes // size, codes % size, n


def stripes_of_words(docs: DataFrame, seed: int, frequent, hot) -> DataFrame:
    """Stripes of every frequent word: the frequent words after it, the rest in OTHER."""

    def work(run: Run):
        common = set_bit(frequent.value, run.ids.view(np.uint64))
        follows = np.zeros(len(run.token), np.int64)
        follows[:-1] = np.where(run.joined[:-1] & common[run.token[1:]], run.token[1:] + 1, 0)
        asked = common[run.token]
        if not asked.any():
            return
        prefix, following, n = _counted(run.token[asked], follows[asked], len(run.ids) + 1)
        w1, ids = run.ids[prefix], np.append(OTHER, run.ids)[following]
        yield from _rows(w1, np.full(len(w1), OTHER), prefix, _parts(hot, w1, ids), ids, n)

    return _merged(_per_run(docs, seed, work, _STRIPE))


def stripes_of_pairs(docs: DataFrame, seed: int, frequent, hot) -> DataFrame:
    """Stripes of every pair that may be frequent: the words that make another such pair with its
    second word, the rest in OTHER."""

    def work(run: Run):
        ids = run.ids[run.token]
        keys = np.zeros(len(ids), np.int64)
        keys[:-1] = pair_key(ids[:-1], ids[1:])
        common = run.joined & set_bit(frequent.value, keys.view(np.uint64))
        at = np.flatnonzero(common)
        if not len(at):
            return
        follows = np.zeros(len(at), np.int64)
        goes_on = common[at + 1]
        follows[goes_on] = run.token[at[goes_on] + 2] + 1
        size = len(run.ids) + 1
        pairs, prefix = np.unique(run.token[at].astype(np.int64) * size + run.token[at + 1], return_inverse=True)
        group, following, n = _counted(prefix, follows, size)
        w1, w2 = run.ids[pairs[group] // size], run.ids[pairs[group] % size]
        after = np.append(OTHER, run.ids)[following]
        yield from _rows(w1, w2, group, _parts(hot, pair_key(w1, w2), after), after, n)

    return _merged(_per_run(docs, seed, work, _STRIPE))


def _merged(stripes: DataFrame) -> DataFrame:
    """Stripes of one prefix and part added entry by entry; entries below LEAST end in the total only.

    A partition is sorted by prefix, so that only the stripe at its end waits for the next batch.
    """
    keys = ["w1", "w2", "part"]

    def add(batches):
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = [batch.column(k).to_numpy() for k in keys]
            sizes = batch.column("next").value_lengths().to_numpy()
            following, n = (batch.column(c).flatten().to_numpy() for c in ("next", "n"))
            if waiting:
                heads = [np.append(a, b) for a, b in zip(waiting[0], heads)]
                sizes = np.append(len(waiting[1]), sizes)
                following, n = np.append(waiting[1], following), np.append(waiting[2], n)
            new = np.concatenate([[True], np.any([h[1:] != h[:-1] for h in heads], axis=0)])
            first = np.flatnonzero(new)
            group = np.repeat(np.cumsum(new) - 1, sizes)
            order = np.lexsort((following, group))
            group, following, n = group[order], following[order], n[order].astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (following[1:] != following[:-1])]))
            group, following, n = group[begin], following[begin], np.add.reduceat(n, begin)
            last = np.searchsorted(group, len(first) - 1)
            waiting = ([h[first[-1:]] for h in heads], following[last:], n[last:])
            if last:
                yield from whole([h[first[:-1]] for h in heads], group[:last], following[:last], n[:last])
        if waiting:
            yield from whole(waiting[0], np.zeros(len(waiting[1]), np.int64), waiting[1], waiting[2])

    def whole(heads, group, following, n):
        w1, w2 = heads[:2]
        total = np.bincount(group, n, len(w1)).astype(np.int64) if n.sum() < 1 << 53 else np.array([n[group == g].sum() for g in range(len(w1))])
        kept = (n >= LEAST) & (following != OTHER)
        group, following, n = group[kept], following[kept], n[kept]
        best = np.zeros(len(w1), np.int64)
        np.maximum.at(best, group, n)
        offsets = pa.array(np.searchsorted(group, np.arange(len(w1) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (following, n, pair_key(w1[group], following))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(w1), pa.array(w2), pa.array(total), pa.array(best), *lists],
            ["w1", "w2", "total", "best", "next", "n", "pair"])

    return stripes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, _MERGED)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts below 10 ** 16."""
    wide = lambda c: c.cast("decimal(38,0)")
    square = (wide(a) * wide(a)).cast("decimal(32,0)")
    return F.call_function("div", (square * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    vocabulary, seed = count_words(docs)
    totals = stage(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = totals.agg(F.sum("n")).first()[0] or 0

    frequent = spark.sparkContext.broadcast(bitmap(vocabulary.where(F.col("n") >= LEAST), "id"))
    first = stage(stripes_of_words(docs, seed, frequent, _hot(vocabulary, "id", "n", words)), "stripes")
    frequent.destroy()
    pairs = first.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).select("x.pair", "x.n")
    frequent = spark.sparkContext.broadcast(bitmap(pairs, "pair"))
    second = stage(stripes_of_pairs(docs, seed, frequent, _hot(pairs, "pair", "n", words)), "stripes")
    frequent.destroy()

    named = stage(
        first.groupBy(F.col("w1").alias("id")).agg(F.sum("total").alias("f")).where(F.col("f") >= LEAST)
        .join(vocabulary.select("id", "lang", "word"), "id"), "named")
    uses = named.select("id", "f")
    two = stage(second.groupBy("w1", "w2").agg(F.sum("total").alias("a"), F.max("best").alias("right_best")).where(F.col("a") >= LEAST), "two")
    three = stage(second.select("w1", "w2", F.explode(F.arrays_zip("next", "n")).alias("x")).select(
        "w1", "w2", F.col("x.next").alias("w3"), F.col("x.n").alias("a")), "three")
    return ranked(_candidates(two, three, uses), named, totals, top)


def _candidates(two: DataFrame, three: DataFrame, uses: DataFrame) -> DataFrame:
    """(w1, w2, w3 or null, a, l, r, score) of the phrases that no longer one subsumes."""
    of = lambda place, name: uses.select(F.col("id").alias(place), F.col("f").alias(name))
    left_best = three.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("left_best"))
    longest = F.greatest("right_best", F.coalesce("left_best", F.lit(0)))
    short = (
        two.join(left_best, ["w1", "w2"], "left").where((longest < LEAST) | (100 * longest < SUBSUMED * F.col("a")))
        .join(of("w1", "l"), "w1").join(of("w2", "r"), "w2")
        .select("w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score")))
    pairs = lambda x, y, name: two.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(name))
    cut = lambda left, right: F.struct(
        score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))
    long = (
        three.join(pairs("w1", "w2", "l2"), ["w1", "w2"]).join(pairs("w2", "w3", "r1"), ["w2", "w3"])
        .join(of("w1", "l1"), "w1").join(of("w3", "r2"), "w3")
        .withColumns({"after_one": cut("l1", "r1"), "after_two": cut("l2", "r2")})
        .withColumn("cut", F.when(F.col("after_two.score") < F.col("after_one.score"), F.col("after_two")).otherwise(F.col("after_one")))
        .select("w1", "w2", "w3", "a", "cut.l", "cut.r", "cut.score"))
    return short.unionByName(long)


def ranked(candidates: DataFrame, named: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The best of each language, by numbers first, so that words are fetched for these and their ties only."""
    near = candidates.join(named.select(F.col("id").alias("w1"), "lang"), "w1").withColumn(
        "place", F.expr("rank() OVER (PARTITION BY lang ORDER BY score DESC, a DESC)")).where(F.col("place") <= top).drop("place")
    spelled = stage(near, "near")
    for place in ("w1", "w2", "w3"):
        spelled = spelled.join(named.select(F.col("id").alias(place), F.col("word").alias(f"word_{place}")), place, "left")
    phrase = F.concat_ws(" ", "word_w1", "word_w2", "word_w3")
    return (
        spelled.withColumn("phrase", phrase)
        .withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"))
        .where(F.col("rank") <= top).join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, pid, words, len(words) AS size FROM (
    SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents) p) q),
totals AS (SELECT lang, CAST(sum(size) AS BIGINT) AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, words, unnest(range(1, size + 1)) AS i, size FROM pieces),
f1 AS (SELECT lang, words[i] AS a1, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 10),
f2 AS (SELECT lang, words[i] AS a1, words[i + 1] AS a2, count(*) AS f FROM places WHERE i + 1 <= size GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, words[i] AS a1, words[i + 1] AS a2, words[i + 2] AS a3, count(*) AS f FROM places WHERE i + 2 <= size GROUP BY ALL HAVING count(*) >= 10),
around AS (
  SELECT lang, a1, a2, max(f) AS f FROM (
    SELECT lang, a1, a2, f FROM f3 UNION ALL SELECT lang, a2 AS a1, a3 AS a2, f FROM f3) x GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.a1 || ' ' || p.a2 AS phrase, 1 AS k, p.f AS a, x.f AS l, y.f AS r FROM f2 p
  JOIN f1 x ON x.lang = p.lang AND x.a1 = p.a1 JOIN f1 y ON y.lang = p.lang AND y.a1 = p.a2
  LEFT JOIN around o ON o.lang = p.lang AND o.a1 = p.a1 AND o.a2 = p.a2
  WHERE o.f IS NULL OR 100 * o.f < 50 * p.f
  UNION ALL
  SELECT p.lang, p.a1 || ' ' || p.a2 || ' ' || p.a3, 1, p.f, x.f, y.f FROM f3 p
  JOIN f1 x ON x.lang = p.lang AND x.a1 = p.a1 JOIN f2 y ON y.lang = p.lang AND y.a1 = p.a2 AND y.a2 = p.a3
  UNION ALL
  SELECT p.lang, p.a1 || ' ' || p.a2 || ' ' || p.a3, 2, p.f, x.f, y.f FROM f3 p
  JOIN f2 x ON x.lang = p.lang AND x.a1 = p.a1 AND x.a2 = p.a2 JOIN f1 y ON y.lang = p.lang AND y.a1 = p.a3),
scored AS (SELECT *, CAST((CAST(a AS HUGEINT) * a * 1000000) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
chosen AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM chosen) c
JOIN totals USING (lang) WHERE rank <= 2000
"""
