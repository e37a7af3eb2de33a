"""Best-fit packing by the configuration linear program.

Documents become token pieces of at most ``capacity``; only the histogram of lengths, at most
``capacity`` rows, reaches the driver. There the configuration program (fewest sequences whose
patterns of lengths cover the histogram) is solved by multiplicative weights: lengths that are
covered least weigh most, and a knapsack dynamic program prices the pattern of greatest weight.
The solution is rounded down; what remains of the histogram is placed by best fit, in the space
that the rounded patterns leave first. The number of patterns is bounded by the rounds, not by
the input.

Back on Spark each piece gets its rank among the pieces of its length, from a count per (length,
bucket) and a row number inside the bucket, so a length with most of the pieces is spread as well.
Length and rank name a sequence and a place in it.

Null and empty texts are the end token alone. Repeated rows are packed each for itself; a null id
stays null. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palaver.llm.byte_tokens import byte_tokens
from palaver.llm.common import documents, map_batches, stage

CAPACITY = 1024
END_ID = 2
#: Most rounds of multiplicative weights, how fast prices fall with the covered share, the part of a
#: count that one use of a pattern covers at most, and how far below the best a pattern may be.
ROUNDS, RATE, STEP, SLACK = 300, 2.0, 0.1, 0.02
#: Parts of the fractional solution that are rounded; the one that needs fewest sequences is taken.
PARTS = (1.0, 0.5, 0.2, 0.1, 0.05)
#: Pieces of one length that a bucket of a rank count should hold.
BUCKET_ROWS = 1_000


def cut(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): every document with its end token, in
    pieces of ``capacity`` of which the first may be shorter."""

    def run(batch: pa.RecordBatch):
        tokens = byte_tokens(True)
        end = np.array([end_id], "<u4").tobytes()
        rows, piece, start, length, crc, kept = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text")):
            ids = tokens.encode(text.as_py() or "") + end
            n = len(ids) // 4
            first = n % capacity or capacity
            bounds = [0, *range(first, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                rows.append(i), piece.append(k), start.append(a), length.append(b - a)
                crc.append(zlib.crc32(ids[4 * a:4 * b]))
                if with_ids:
                    kept.append(ids[4 * a:4 * b])
        arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                  pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(
            arrays + [pa.array(kept, pa.binary())] * with_ids,
            names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return map_batches(docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text"), run,
                       "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids, release=True)


def price(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack program: for each room the greatest worth of what fits, and the length to take
    first (0: leave one token of room). Lengths without a price are not for sale."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        worth = prices[1:room + 1] + best[room - 1::-1][:room]
        k = int(worth.argmax())
        best[room], first[room] = (worth[k], k + 1) if worth[k] > best[room - 1] else (best[room - 1], 0)
    return best, first


def pattern_from(start: int, first: np.ndarray, counts: np.ndarray, capacity: int) -> tuple:
    """((length, copies), ...) with one ``start`` and what the program fills the rest with."""
    items, room = {start: 1}, capacity - start
    while room > 0:
        length = int(first[room])
        items[length] = items.get(length, 0) + 1
        room -= length or 1
    items.pop(0, None)
    return tuple(sorted(((x, min(k, int(counts[x]))) for x, k in items.items()), reverse=True))


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Fractional numbers of patterns that cover the counts: pattern -> number.

    Prices start in proportion to length and fall exponentially with the covered share. One
    knapsack program a round prices, for every length, the best pattern that holds it; those
    within ``SLACK`` of the best of all are used a little, the least covered lengths first.
    """
    lengths = np.flatnonzero(counts)
    share = np.zeros(capacity + 1)
    used: dict[tuple, float] = {}
    for _ in range(rounds if len(lengths) else 0):
        if share[lengths].min() >= 1:
            break
        prices = np.full(capacity + 1, -np.inf)
        prices[lengths] = lengths * np.exp(-RATE * (share[lengths] - share[lengths].min()))
        best, first = price(prices, capacity)
        worth = prices[lengths] + best[capacity - lengths]
        good = lengths[(worth >= (1 - SLACK) * worth.max()) & (share[lengths] < 1)]
        touched: set[int] = set()
        for start in good[np.argsort(share[good], kind="stable")].tolist():
            pattern = pattern_from(start, first, counts, capacity)
            if touched.isdisjoint(x for x, _ in pattern):
                touched.update(x for x, _ in pattern)
                number = min(counts[x] / k for x, k in pattern) * STEP
                used[pattern] = used.get(pattern, 0.0) + number
                for x, k in pattern:
                    share[x] += k * number / counts[x]
    return used


def plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple, int]]:
    """(pattern, number of sequences) that hold exactly the counts; a pattern is ((length, copies), ...)."""
    smaller = counts.astype(np.int64).copy()
    smaller[capacity] = 0
    solution = solve(smaller, capacity, rounds)
    plans = [rounded(counts, {p: part * x for p, x in solution.items()}, capacity) for part in PARTS]
    return min(plans, key=lambda patterns: sum(n for _, n in patterns))


def rounded(counts: np.ndarray, solution: dict[tuple, float], capacity: int) -> list[tuple[tuple, int]]:
    """Whole numbers of the patterns, then best fit, longest first, for what is left."""
    left = counts.astype(np.int64).copy()
    open_bins: dict[int, list[list]] = {}
    full = int(left[capacity])
    left[capacity] = 0
    for pattern, x in sorted(solution.items(), key=lambda p: (-p[1], p[0])):
        n = min([int(x), *(int(left[length]) // k for length, k in pattern)])
        if n > 0:
            for length, k in pattern:
                left[length] -= n * k
            free = capacity - sum(length * k for length, k in pattern)
            open_bins.setdefault(free, []).append([pattern, n])
    for length in range(capacity, 0, -1):
        need = int(left[length])
        while need:
            free = next((f for f in range(length, capacity) if open_bins.get(f)), None)
            if free is None:
                k = min(capacity // length, need)
                opened = need // k
                pattern, rest = ((length, k),), capacity - k * length
                need -= opened * k
            else:
                old, there = open_bins[free][-1]
                opened = min(there, need)
                open_bins[free][-1][1] -= opened
                if not open_bins[free][-1][1]:
                    open_bins[free].pop()
                items = dict(old)
                items[length] = items.get(length, 0) + 1
                pattern, rest = tuple(sorted(items.items(), reverse=True)), free - length
                need -= opened
            open_bins.setdefault(rest, []).append([pattern, opened])
    merged: dict[tuple, int] = {((capacity, 1),): full} if full else {}
    for bins in open_bins.values():
        for pattern, n in bins:
            merged[pattern] = merged.get(pattern, 0) + n
    return sorted(merged.items())


def runs_of(patterns: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """For each length its runs of ranks: columns first rank, copies, first sequence, first offset."""
    runs: dict[int, list[tuple]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length, k in pattern:
            first = ranks.get(length, 0)
            runs.setdefault(length, []).append((first, k, sequence, offset))
            ranks[length] = first + n * k
            offset += length * k
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to staged pieces."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    runs = runs_of(plan(counts, capacity, rounds))
    # A length has as many buckets as its count asks for.
    buckets = F.get(F.array(*[F.lit(max(1, -(-int(n) // BUCKET_ROWS))) for n in counts]), F.col("length").cast("int"))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), buckets))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ranks_before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (dealt.withColumn("rank", F.row_number().over(inside) - 1).join(sizes, ["length", "bucket"])
              .withColumn("rank", F.col("rank") + F.col("ranks_before")).drop("ranks_before", "bucket"))
    columns = list(pieces.columns)

    def run(batch: pa.RecordBatch):
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for each in np.unique(length):
            at = np.flatnonzero(length == each)
            table = runs[int(each)]
            row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
            inner = rank[at] - row[:, 0]
            sequence[at] = row[:, 2] + inner // row[:, 1]
            offset[at] = row[:, 3] + inner % row[:, 1] * each
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)],
                                         names=columns + ["sequence_id", "offset"])

    fields = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return map_batches(ranked.select(*columns, "rank"), run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(stage(cut(docs, capacity), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sequences of all documents that are left."""
    return pack_documents(docs)
