"""Authors: the ``authors`` array that every comment document carries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palaver.schemas import AUTHOR_SIGHTINGS, RAW_AUTHORS
from palaver.sources.comments import day_in_name

# The reader skips what the schema does not name without recursion.
_NESTING = 1_000_000


def read_author_sightings(spark: SparkSession, root: str) -> DataFrame:
    """One row per author per document, seen on the day in the file name.

    The schema names the ``authors`` array only, so the comment tree is skipped by the
    JSON reader. A name without a day gives a null ``seen_at``.
    """
    rows = (
        spark.read.schema(RAW_AUTHORS)
        .option("multiLine", True)
        .option("maxNestingDepth", _NESTING)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(root)
        .select(F.col("_metadata.file_name").alias("file"), F.explode("authors").alias("a"))
    )
    return _typed_sightings(rows)


def _typed_sightings(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("a.id").alias("author_id"),
        "a.username", "a.active", "a.newbie", "a.banned", "a.premium",
        F.col("a.registered_at").try_cast("timestamp_ntz").alias("registered_at"),
        day_in_name().cast("timestamp_ntz").alias("seen_at"),
    ).select(*AUTHOR_SIGHTINGS.names)


def sightings_of(opened: DataFrame) -> DataFrame:
    """The same rows from documents that are opened already; a field of the wrong type is null."""
    return _typed_sightings(opened.select("file", F.explode("people").alias("a")))


def undated_files(spark: SparkSession, root: str) -> DataFrame:
    """Files whose name carries no valid day, for the error table."""
    names = list_files(spark, root).select("file")
    return names.where(day_in_name().isNull()).select("file", F.lit("no day in name").alias("reason"))


def list_files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Files below ``root`` as a relation. Only the listing is read, never the contents."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    )
