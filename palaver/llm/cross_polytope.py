"""Nearest neighbours by cross-polytope hashing.

A vector is scaled to unit length, multiplied by random signs and run through the Hadamard
transform, three times over; its bucket is the nearest signed axis of what comes out. ``TABLES``
such rotations file every vector once each. A query looks into the buckets of its several nearest
signed axes in every table; inner products with all vectors found there are exact.

Largest inner product becomes nearest direction: vectors are filed by bands of norm, a factor of
``FACTOR`` each. Where the norms of a band differ, its vectors get one more component that lifts them
to the band's longest norm, and queries get 0 there. A query looks into every band. Bands of at most
``BLOCK`` vectors beside others are one bucket together, which is searched whole.

Work is dealt in blocks of at most ``BLOCK`` vectors by ``BLOCK`` queries of a bucket: the bucket's
counts, at most tables x 2 x dimension rows, say how many, so a bucket with most of all vectors
is many tasks' work, an id's rows too. Each block returns the best k ids of a query by their best rows,
ties to the smaller id; repeated rows are merged first.

A query with fewer than k found looks at all vectors, in the same blocks.

Null, zero and non-finite vectors take no part; vectors of another dimension than a query's aren't
compared with it. Rows that share an id are one candidate, with its best score, and never a
neighbour of that id; rows without an id take no part. Columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palaver.llm.common import map_batches, stage

#: Rotations, and one probe of a query for so many of a table's buckets.
TABLES, BUCKETS_PER_PROBE = 20, 16
BLOCK = 4096
FACTOR = 1.1
#: The band that stands for all small ones.
SMALL_BANDS = 1 << 20
EVERY = 20
NEIGHBOURS = 20


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of random signs and the Hadamard transform; rows have a power of two columns."""
    n, d = x.shape
    signs = np.random.default_rng([table, d]).choice([-1.0, 1.0], (3, d))
    for each in signs:
        x, half = x * each, 1
        while half < d:
            pairs = x.reshape(n, d // (2 * half), 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
            half *= 2
    return x


def axes(x: np.ndarray, table: int) -> np.ndarray:
    """Signed projections on all axes: columns 0..d-1 are the positive ones."""
    turned = rotate(x, table)
    return np.concatenate([turned, -turned], axis=1)


def padded(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Unit directions in a power of two columns; with ``longest``, lifted to that norm first."""
    norm = np.linalg.norm(x, axis=1)
    if longest is not None:
        x = np.concatenate([x, np.sqrt(np.maximum(longest ** 2 - norm ** 2, 0))[:, None]], axis=1)
        norm = np.linalg.norm(x, axis=1)
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    return np.pad(x / norm[:, None], ((0, 0), (0, width - x.shape[1])))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, dimension, norm, band, vector (double) of the rows that take part."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    # Rounded, so that norms of about 1 are inside a band; norms too large for a double are with the small bands.
    band = F.when(F.col("norm") < F.lit(float("inf")), F.round(F.log("norm") / math.log(FACTOR)).cast("int")).otherwise(SMALL_BANDS)
    return (vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector"))
            .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(fit)
            .select("vec_id", F.size("vector").alias("dimension"), norm.alias("norm"), "vector").filter("norm > 0")
            .select("vec_id", "dimension", "norm", band.alias("band"), "vector"))


FILED = "dimension int, band int, table int, bucket int, vec_id long, vector binary"


def file_vectors(vectors: DataFrame, lifts: dict[int, dict[int, float | None]], tables: int, probe: bool) -> DataFrame:
    """(dimension, band, table, bucket, vec_id, vector): once per table, or per probe of it in every
    band. ``lifts`` has, by dimension, the norm that each hashed band is lifted to."""

    def run(batch: pa.RecordBatch):
        dimension, bands, ids = (batch.column(c).to_numpy() for c in ("dimension", "band", "vec_id"))
        flat, offsets = batch.column("vector").values.to_numpy(zero_copy_only=False), batch.column("vector").offsets.to_numpy()

        def filed(d: int, band: int, table: int, buckets: np.ndarray, rows: np.ndarray, raw: list[bytes]):
            n, m = buckets.shape
            return pa.RecordBatch.from_arrays(
                [*[pa.array(np.full(n * m, v, np.int32)) for v in (d, band, table)],
                 pa.array(buckets.reshape(-1).astype(np.int32)), pa.array(np.repeat(ids[rows], m)),
                 pa.array([v for v in raw for _ in range(m)], pa.binary())],
                names=["dimension", "band", "table", "bucket", "vec_id", "vector"])

        for d in map(int, np.unique(dimension)):
            known, of_d = lifts.get(d, {}), np.flatnonzero(dimension == d)
            hashed = np.isin(bands[of_d], list(known))
            # A query is turned alike for all bands that are lifted, and for all that aren't.
            groups = ([(of_d, lift, [b for b in known if (known[b] is None) == (lift is None)]) for lift in {None if v is None else 1.0 for v in known.values()}]
                      if probe else [(of_d[bands[of_d] == b], known[b], [int(b)]) for b in np.unique(bands[of_d][hashed])])
            for rows, lift, into in groups:
                x = np.stack([flat[offsets[r]:offsets[r + 1]] for r in rows])
                unit = padded(np.concatenate([x, np.zeros((len(x), 1))], axis=1), None) if probe and lift is not None else padded(x, lift)
                raw = [row.tobytes() for row in x]
                for table in range(tables):
                    near = axes(unit, table)
                    buckets = np.argsort(-near, axis=1, kind="stable")[:, :max(1, near.shape[1] // BUCKETS_PER_PROBE)] if probe else near.argmax(axis=1)[:, None]
                    for band in into:
                        yield filed(d, band, table, buckets, rows, raw)
            rows = of_d if probe else of_d[~hashed]
            if len(rows):
                yield filed(d, SMALL_BANDS, 0, np.zeros((len(rows), 1)), rows, [flat[offsets[r]:offsets[r + 1]].tobytes() for r in rows])

    return map_batches(vectors.select("dimension", "band", "vec_id", "vector"), run, FILED)


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query id, id, score) of the best k ids of each query in a block."""
    out = []
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    for at in range(0, len(query_ids), 32):
        q, own = queries[at:at + 32], query_ids[at:at + 32]
        rough = q @ vectors.T
        rough[own[:, None] == ids[None, :]] = -np.inf
        best = rough if len(starts) == len(ids) else np.maximum.reduceat(rough, starts, axis=1)
        kth = np.partition(best, -k, axis=1)[:, -k] if len(starts) > k else np.full(len(q), -np.inf)
        margin = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(kth), kth, 1.0)))
        rows, columns = np.nonzero((rough >= (kth - margin)[:, None]) & np.isfinite(rough))
        # One sum for each pair, so that equal vectors get equal scores.
        scores = (q[rows] * vectors[columns]).sum(axis=1)
        found = ids[columns]
        sort = np.lexsort((-scores, found, rows))
        rows, found, scores = rows[sort], found[sort], scores[sort]
        # Of an id's rows the best, before places are counted.
        first = np.concatenate([[True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])])[:len(rows)]
        rows, found, scores = rows[first], found[first], scores[first]
        sort = np.lexsort((found, -scores, rows))
        rows, found, scores = rows[sort], found[sort], scores[sort]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        few = place < k
        out.append((own[rows[few]], found[few], scores[few]))
    return [np.concatenate(x) for x in zip(*out)]


def compare(filed: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Best k of every query in every block it looks at: query_id, vec_id, score."""
    key = ["dimension", "band", "table", "bucket"]
    counts = (filed.groupBy(key).agg(F.count("*").alias("vectors"))
              .join(probes.groupBy(key).agg(F.count("*").alias("queries")), key)
              .select(*key, F.ceil(F.col("vectors") / BLOCK).cast("int").alias("parts"),
                      F.ceil(F.col("queries") / BLOCK).cast("int").alias("query_parts")))
    counts = F.broadcast(stage(counts, "buckets"))  # at most tables x 2 x dimension rows for each band of a dimension
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.col(n)).cast("int")
    left = filed.join(counts, key).select(*key, part("parts").alias("part"), every("query_parts").alias("query_part"), "vec_id", "vector", F.lit(False).alias("query"))
    right = probes.join(counts, key).select(*key, every("parts").alias("part"), part("query_parts").alias("query_part"), "vec_id", "vector", F.lit(True).alias("query"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["query"].to_numpy()
        ids, d = pdf["vec_id"].to_numpy(), int(pdf["dimension"].iloc[0])
        if is_query.all() or not is_query.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x = np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(-1, d)
        query_id, vec_id, score = best_of_block(ids[is_query], x[is_query], ids[~is_query], x[~is_query], k)
        return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})

    return left.union(right).groupBy(*key, "part", "query_part").applyInPandas(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: str, k: int = NEIGHBOURS, tables: int = TABLES,
           id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the rows that ``is_query``, SQL over vec_id, is true for."""
    points = usable(vectors, id_column, vector_column)
    points = stage(points.dropDuplicates(["vec_id", "vector"]), "points")
    norms = (points.groupBy("dimension", "band").agg(F.min("norm").alias("least"), F.max("norm").alias("most"), F.count("*").alias("n"))
             .collect())  # a row per band of a dimension
    bands = Counter(r["dimension"] for r in norms)
    lifts: dict[int, dict[int, float | None]] = {}
    for r in norms:
        if r["band"] != SMALL_BANDS and (r["n"] > BLOCK or bands[r["dimension"]] == 1):
            lifts.setdefault(r["dimension"], {})[r["band"]] = None if r["most"] - r["least"] <= 1e-4 * r["most"] else r["most"]
    filed = file_vectors(points, lifts, tables, False)
    probes = file_vectors(points.filter(is_query), lifts, tables, True)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def nearest(found: DataFrame) -> DataFrame:
        return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
                .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))

    found = stage(nearest(compare(filed, probes, k)), "found")
    complete = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = stage(points.filter(is_query).join(complete, "vec_id", "left_anti").select("vec_id", "dimension", "vector"), "short")
    if not short.isEmpty():
        whole = lambda df: map_batches(df.select("dimension", "vec_id", "vector"), _one_bucket, FILED)
        rest = nearest(compare(whole(points), whole(short), k))
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _one_bucket(batch: pa.RecordBatch):
    n = batch.num_rows
    zero = pa.array(np.zeros(n, np.int32))
    raw = [np.array(v.as_py(), np.float64).tobytes() for v in batch.column("vector")]
    yield pa.RecordBatch.from_arrays([batch.column("dimension"), zero, zero, zero, batch.column("vec_id"), pa.array(raw, pa.binary())],
                                     names=["dimension", "band", "table", "bucket", "vec_id", "vector"])


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), f"vec_id % {EVERY} = 0")
