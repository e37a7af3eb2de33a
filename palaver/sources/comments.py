"""Comments: one JSON document per post below a directory per year, nested to any depth."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palaver.operators.threads import STEPS, first_frontier, walk
from palaver.schemas import RAW_AUTHORS

ENTRY = RAW_AUTHORS["authors"].dataType.elementType.simpleString()
_DAY_IN_NAME = r"(\d{4}_\d{2}_\d{2})"


def day_in_name() -> Column:
    """The day in the name of ``file``, null without a valid one."""
    return F.try_to_date(F.regexp_extract("file", _DAY_IN_NAME, 1), "yyyy_MM_dd")


#: Levels of JSON that the parser goes down; a reply takes two. A stack of 1 MB holds about 3,500
#: levels: for deeper documents raise this and start executors with a larger stack, for example
#: ``spark.executor.extraJavaOptions=-Xss16m`` for 40,000 levels. Only the parser needs it.
MAX_LEVELS = 2_500


def read_documents(spark: SparkSession, root: str, years: Iterable[int] | None = None) -> DataFrame:
    """One row per ``*.json`` file at any depth below ``root``: ``path``, ``file``, ``year``, ``text``.

    ``year`` is the all-digit directory of ``root`` that directly holds the file, else null: such
    files name authors, but their comments are not loaded. ``years`` narrows the listing itself,
    so that other years are never opened.
    """
    reader = spark.read.option("pathGlobFilter", "*.json")
    if years is None:
        files = reader.option("recursiveFileLookup", True).text(root, wholetext=True)
    else:
        files = reader.text(f"{root}/{{{','.join(str(y) for y in years)}}}/*.json", wholetext=True)
    folder = re.escape(quote(root.rstrip("/").rsplit("/", 1)[-1]))
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.regexp_extract("_metadata.file_path", rf"/{folder}/([0-9]+)/[^/]+$", 1).try_cast("int").alias("year"),
        F.col("value").alias("text"))


def parsed(text: str, max_levels: int = MAX_LEVELS) -> Column:
    """A JSON text as a variant; null for text that is no JSON or is nested too deeply."""
    return F.from_json(text, "variant", {"maxNestingDepth": str(max_levels)})


def open_documents(files: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """All that loads take from a document, from one parse of its text: whether it is ``readable``,
    its ``post_id``, the author entries ``people`` and the comments ``found``; of documents so deep
    that a ``frontier`` is left, the ``text``, too. Comments are only looked for where they will be
    loaded: in a document of a year that names its post."""
    docs = files.withColumn("doc", parsed("text", max_levels))
    loads = F.col("year").isNotNull() & F.col("post_id").isNotNull()
    return docs.select(
        "path", "file", "year", "text", "doc", F.col("doc").isNotNull().alias("readable"),
        F.try_variant_get("doc", "$.summary.id", "bigint").alias("post_id"),
        F.try_variant_get("doc", "$.authors", f"array<{ENTRY}>").alias("people"), first_frontier(F.col("doc")).alias("tops"),
    ).withColumn("walked", F.when(loads, walk(F.col("doc"), F.col("tops"), STEPS))).select(
        "path", "file", "year", "readable", "post_id", "people", "walked.found", "walked.frontier",
        F.when(F.size("walked.frontier") > 0, F.col("text")).alias("text"))


def compact_documents(spark: SparkSession, root: str, target: str, years: Iterable[int] | None = None) -> DataFrame:
    """Opens the many small documents once and keeps what loads take from them as Parquet; loads
    and repairs that read ``target`` parse nothing."""
    open_documents(read_documents(spark, root, years)).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _left_out() -> Column:
    """Why a document's comments are not loaded, null if they are."""
    return F.when(~F.col("readable"), "unreadable").when(F.col("year").isNull(), "not in a year folder").when(
        F.col("post_id").isNull(), "no summary id")


def comment_errors(opened: DataFrame) -> DataFrame:
    """``file`` and ``reason`` of the documents whose comments are not loaded."""
    return opened.select("file", _left_out().alias("reason")).where("reason IS NOT NULL")


def document_status(opened: DataFrame) -> DataFrame:
    """What a load makes of each file: ``path``, ``file``, ``year``, ``comments`` (``loads``, or why
    not) and its author entries: ``sightings``, and how many lack an id, a name or a day."""
    entries = F.coalesce("people", F.array().cast(f"array<{ENTRY}>"))
    lacking = lambda field: F.size(F.filter(entries, lambda a: a[field].isNull()))
    return opened.select(
        "path", "file", "year", F.coalesce(_left_out(), F.lit("loads")).alias("comments"), F.size(entries).alias("sightings"),
        lacking("id").alias("without_id"), lacking("username").alias("without_name"),
        F.when(day_in_name().isNull(), F.size(entries)).otherwise(0).alias("without_day"))
