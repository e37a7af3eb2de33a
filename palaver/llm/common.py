"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from palaver.session import stage, work_dir

__all__ = ["documents", "input_splits", "map_batches", "release_memory", "stage", "text_classes", "with_row_id", "work_dir", "words_of"]

#: What separates words: space and the six ASCII controls from tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null and for text without words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own, staged, so that the number survives a recomputed task."""
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def release_memory() -> None:
    """Gives back what a worker's allocators keep for later: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType, release: bool = False,
) -> DataFrame:
    """``mapInArrow`` of a function of one batch. With ``release``, a task gives its memory back at the end."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
        if release:
            release_memory()

    return df.mapInArrow(run, schema)


def input_splits(df: DataFrame, least: int = 1) -> int:
    """Partitions that follow the input: those of its scan, or the session's shuffle partitions."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, wanted)


def text_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row's key, class): the class of equal texts is their smallest key; only hashes are shuffled."""
    hashed = docs.select(F.col(key).alias("member"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    first = hashed.groupBy("digest").agg(F.min("member").alias("representative"))
    return hashed.join(first, "digest").select("member", "representative")
