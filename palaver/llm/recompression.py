"""Substring dedup by recompression.

A text is a string of words. Rounds of recompression replace short runs of one symbol, then pairs of
a left and a right symbol, by names that are hashes of what they stand for: the same everywhere, on
every executor, with no table of names to build or shuffle. Whether a symbol is left or right in a
round is a bit of its hash. So a name depends on its words and on at most ``MARGIN`` words around
them, and equal substrings have equal symbols but for that margin at either end.

A window of 50 words has, inside its margins, at least one whole top-level symbol. The smallest of
these by hash, with the margin on either side, stands for the window: 27 words or more that lie in
it, and equal windows have the same.

1. Stretches that stand for windows of more than one document are found by one aggregate and kept as
   a bitmap of fixed size; more bits than needed cost time, not rows.
2. Windows that such a stretch stands for are verified by the hash of all their words: each hash
   gets its smallest document, and larger documents lose the window's words.

Windows are judged on the input. Null, empty and short texts have no windows and lose nothing. Rows
without an id take no part and keep everything. Repeated rows of an id do not dedup one another and
get equal rows. Columns other than id and text are not read. Names and window hashes have 64 bits:
among 10^9 windows a false match is expected for one in 10^10.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from palaver.llm import hashing
from palaver.llm.common import documents, map_batches, stage
from palaver.llm.graph import bitmap

WINDOW = 50
#: Longest run that is named, and rounds of pairs after it.
RUN, ROUNDS = 3, 2
#: Words of context that a top-level symbol depends on: a run sees one word more than it may
#: have, and each round of pairs one neighbour of the length symbols have by then.
MARGIN = (RUN + 1) + RUN * (2 ** ROUNDS - 1)
#: Most words of a top-level symbol. A window must hold one whole inside its margins.
LONGEST = RUN * 2 ** ROUNDS
assert WINDOW - 2 * MARGIN >= 2 * LONGEST - 1
_PLACE = 30  # bits of a symbol's place in its run of texts


def _named(first: np.ndarray, second: np.ndarray | int, round_no: int) -> np.ndarray:
    return hashing.mix(first * np.uint64(0x9FB21C651E98DF25) + hashing.mix(np.asarray(second, np.uint64) + np.uint64(round_no + 1)))


def name_runs(symbols: np.ndarray, starts: np.ndarray, text: np.ndarray):
    """Maximal runs of 2 to ``RUN`` equal symbols of a text become one symbol; longer ones stay."""
    n = len(symbols)
    new = np.ones(n, bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    short = (size >= 2) & (size <= RUN)
    keep = np.ones(n, bool)
    for j in range(1, RUN):
        inner = at[short & (size > j)] + j
        keep[inner] = False
    out = symbols.copy()
    out[at[short]] = _named(symbols[at[short]], size[short].astype(np.uint64), 0)
    return out[keep], starts[keep], text[keep]


def name_pairs(symbols: np.ndarray, starts: np.ndarray, text: np.ndarray, round_no: int):
    """Every left symbol followed by a right one of the same text becomes one symbol with it."""
    left = (hashing.mix(symbols + np.uint64(round_no)) & np.uint64(1)) == 0
    joined = np.zeros(len(symbols), bool)
    joined[:-1] = left[:-1] & ~left[1:] & (text[:-1] == text[1:])
    at = np.flatnonzero(joined)
    out = symbols.copy()
    out[at] = _named(symbols[at], symbols[at + 1], round_no)
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return out[keep], starts[keep], text[keep]


def recompress(words: np.ndarray, text: np.ndarray):
    """(symbol, first word, word after the last) of the top level."""
    symbols, starts, of = words, np.arange(len(words)), text
    if len(symbols):
        symbols, starts, of = name_runs(symbols, starts, of)
        for round_no in range(1, ROUNDS + 1):
            symbols, starts, of = name_pairs(symbols, starts, of, round_no)
    ends = np.append(starts[1:], len(words))
    return symbols, starts, ends


def stretch_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of words[first:last] each."""
    sums = hashing.prefix_sums(words)
    _, down = hashing.powers(len(words))
    return hashing.mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def windows(words: np.ndarray, text: np.ndarray, window: int = WINDOW):
    """(first word, stretch that stands for it) of all windows of one text each. The stretch is the
    window's smallest symbol, the leftmost if several, with the margin on either side."""
    n = len(words)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first = np.flatnonzero(text[:n - window + 1] == text[window - 1:])
    symbols, starts, ends = recompress(words, text)
    low = np.searchsorted(starts, first + MARGIN)
    high = np.searchsorted(ends, first + window - MARGIN, side="right") - 1
    # Smallest symbol of low..high from two overlapping ranges of a power of two.
    power = np.log2(high - low + 1).astype(np.int64)
    places = np.uint64((1 << _PLACE) - 1)
    table, best = (symbols & ~places) | np.arange(len(symbols), dtype=np.uint64), np.empty(len(first), np.uint64)
    for k in range(int(power.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(power == k)
        best[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
    chosen = (best & places).astype(np.int64)
    new = np.ones(len(first), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[first[1:]] != text[first[:-1]])
    of = chosen[new]
    stretches = stretch_hashes(words, starts[of] - MARGIN, ends[of] + MARGIN)
    return first, stretches[np.cumsum(new) - 1] if len(first) else np.empty(0, np.uint64)


def window_hashes(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    sums = hashing.prefix_sums(words)
    _, down = hashing.powers(len(words))
    return hashing.mix((sums[first + window] - sums[first]) * down[first])


def standing_symbols(docs: DataFrame) -> DataFrame:
    """(symbol, doc_id) of the symbols that stand for windows."""

    def run(batch: pa.RecordBatch):
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for row0, data, offsets in hashing.chunks(batch.column("text")):
            words, row, _, _ = hashing.words(data, offsets, False)
            first, symbol = windows(words, row)
            if len(first):
                # Neighbouring windows share their symbol; the aggregate merges what is left.
                new = np.ones(len(first), bool)
                new[1:] = (symbol[1:] != symbol[:-1]) | (row[first[1:]] != row[first[:-1]])
                at = first[new]
                yield pa.RecordBatch.from_arrays([pa.array(symbol[new].view(np.int64)), pa.array(ids[row0 + row[at]].astype(np.int64))], names=["symbol", "doc_id"])

    return map_batches(docs, run, "symbol long, doc_id long")


def suspect_windows(docs: DataFrame, shared) -> DataFrame:
    """(window, doc_id): hashes of the windows that stand under a shared symbol."""

    def run(batch: pa.RecordBatch):
        bits = shared.value
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for row0, data, offsets in hashing.chunks(batch.column("text")):
            words, row, _, _ = hashing.words(data, offsets, False)
            first, symbol = windows(words, row)
            if len(first):
                first = first[hashing.set_bit(bits, symbol)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window_hashes(words, first).view(np.int64)), pa.array(ids[row0 + row[first]].astype(np.int64))], names=["window", "doc_id"])

    return map_batches(docs, run, "window long, doc_id long")


def _removed(words: np.ndarray, lost: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words of one text lie in a window whose hash is lost."""
    removed = np.zeros(len(words) + 1, np.int64)
    if len(words) >= window and len(lost):
        first = np.arange(len(words) - window + 1)
        hit = first[np.isin(window_hashes(words, first), lost)]
        np.add.at(removed, hit, 1)
        np.add.at(removed, hit + window, -1)
    return np.cumsum(removed[:-1]) > 0


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every row."""
    docs = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    spark = docs.sparkSession
    known = docs.filter("doc_id IS NOT NULL")
    found = standing_symbols(known).groupBy("symbol").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    shared = spark.sparkContext.broadcast(bitmap(found, "symbol"))
    suspects = suspect_windows(known, shared)
    owners = suspects.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    lost = stage(suspects.join(owners, "window").filter("doc_id > low").groupBy("doc_id").agg(F.collect_set("window").alias("lost")), "lost")
    touched = spark.sparkContext.broadcast(bitmap(lost.select("doc_id"), "doc_id"))
    schema = SCHEMA + ", kept_text string" * with_text

    def result(ids: pa.Array, texts: pa.Array, lost_of) -> pa.RecordBatch:
        total, gone, sha, kept_texts = [], [], [], []
        for row0, data, offsets in hashing.chunks(texts):
            words, row, begins, ends = hashing.words(data, offsets, False)
            bounds = np.searchsorted(row, np.arange(len(offsets)))
            raw = data.tobytes()
            for i in range(len(offsets) - 1):
                a, b = bounds[i], bounds[i + 1]
                removed = _removed(words[a:b], lost_of(row0 + i))
                total.append(int(b - a)), gone.append(int(removed.sum()))
                keep = np.flatnonzero(~removed) + a
                kept = b" ".join([raw[s:e] for s, e in zip(begins[keep].tolist(), ends[keep].tolist())])
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())] + [pa.array(kept_texts, pa.string())] * with_text,
            names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    none = np.empty(0, np.uint64)

    def bit_of(ids: pa.Array) -> np.ndarray:
        known_id = ids.is_valid().to_numpy(zero_copy_only=False)
        return known_id & hashing.set_bit(touched.value, ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64))

    def untouched(batch: pa.RecordBatch):
        rest = batch.filter(pa.array(~bit_of(batch.column("doc_id"))))
        if rest.num_rows:
            yield result(rest.column("doc_id"), rest.column("text"), lambda _: none)

    def maybe(batch: pa.RecordBatch):
        yield batch.filter(pa.array(bit_of(batch.column("doc_id"))))

    def apply(batch: pa.RecordBatch):
        sets = batch.column("lost")
        yield result(batch.column("doc_id"), batch.column("text"),
                     lambda i: sets[i].values.to_numpy(zero_copy_only=False).view(np.uint64) if sets[i].is_valid else none)

    hit = map_batches(docs, maybe, "doc_id long, text string").join(lost, "doc_id", "left")
    return map_batches(docs, untouched, schema).unionByName(map_batches(hit.select("doc_id", "text", "lost"), apply, schema))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
