"""Connected components by large and small stars, and bitmaps of key sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palaver.llm.common import map_batches, stage
from palaver.llm.hashing import mix, set_bit

#: Bits of a bitmap: 16 MB, at any input size.
BITS = 1 << 27
SLICES = 64
#: Tasks that fill slices, and jobs that bring these to the driver, one task's at a time.
FILLERS = 16


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the root of a component is its smallest node; roots themselves and nodes
    without edges are left out. ``edges`` has columns a and b."""
    links = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("u", "v", "m")
        links = stage(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A fixed-size bitmap with the keys' bits set. Slices are made by tasks; the driver gets
    ``BITS / 8`` bytes however many keys there are."""
    span = BITS // SLICES

    def places(batches):
        for pdf in batches:
            at = np.unique(mix(pdf["key"].to_numpy().view(np.uint64)) & np.uint64(BITS - 1))
            yield pd.DataFrame({"bit": at.astype(np.int64)})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["bit"].to_numpy()
        part = np.zeros(span, bool)
        part[at % span] = True
        return pd.DataFrame({"slice": [int(at[0] // span)], "bits": [np.packbits(part, bitorder="little").tobytes()]})

    found = (keys.select(F.col(column).cast("long").alias("key")).mapInPandas(places, "bit long").distinct()
             .groupBy(F.floor(F.col("bit") / span).alias("slice_no")).applyInPandas(fill, "slice long, bits binary").coalesce(FILLERS))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in found.toLocalIterator():
        bits[row["slice"] * (span // 8):(row["slice"] + 1) * (span // 8)] = np.frombuffer(row["bits"], np.uint8)
    return bits


def rows_by_bit(df: DataFrame, column: str, bits, has: bool) -> DataFrame:
    """The rows whose key has its bit in a broadcast bitmap, or those whose key has not; a null
    key has none."""

    def run(batch):
        keys = batch.column(column)
        hit = keys.is_valid().to_numpy(zero_copy_only=False) & set_bit(bits.value, keys.fill_null(0).to_numpy().astype(np.int64).view(np.uint64))
        yield batch.filter(pa.array(hit if has else ~hit))

    return map_batches(df, run, df.schema)
