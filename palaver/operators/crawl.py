"""Completeness of a crawl: which posts lack their comment document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def comment_file_name(day: Column, composite_id: Column) -> Column:
    """``YYYY/YYYY_MM_DD_<composite id>.json`` for a day given as ``YYYY-MM-DD`` text."""
    return F.concat(
        F.substring(day, 1, 4), F.lit("/"), F.replace(day, F.lit("-"), F.lit("_")),
        F.lit("_"), composite_id, F.lit(".json"))


def api_path(composite_id: Column) -> Column:
    return F.replace(composite_id, F.lit("_"), F.lit("/"))


def crawl_calendar(bounds: DataFrame) -> DataFrame:
    """Every day from ``first_day`` to ``last_day``, both included, of each row."""
    return bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("day"))


def crawl_gaps(posts: DataFrame, files: DataFrame) -> DataFrame:
    """Per day: posts, posts without a comment document, and whether the day is complete.

    ``posts`` holds ``day`` (text) and ``composite_id``; ``files`` holds ``file`` in the
    form of ``comment_file_name``. Posts without a composite id need no document: they are not
    counted, and a day with no other posts is complete.
    """
    named = F.coalesce(F.col("composite_id") != "", F.lit(False))
    wanted = posts.select(
        "day", named.alias("named"),
        F.when(named, comment_file_name(F.col("day"), F.col("composite_id"))).alias("file"))
    present = files.select("file", F.lit(True).alias("present")).distinct()
    missing = F.col("named") & F.col("present").isNull()
    return wanted.join(present, "file", "left").groupBy("day").agg(
        F.count_if("named").alias("posts"),
        F.count_if(missing).alias("missing"),
        F.bool_and(~missing).alias("complete"),
    )


def missing_posts(posts: DataFrame, files: DataFrame) -> DataFrame:
    """Posts whose comment document is still to be fetched, with their request path."""
    wanted = posts.where("composite_id <> ''").withColumn(
        "file", comment_file_name(F.col("day"), F.col("composite_id")))
    return wanted.join(files.select("file"), "file", "left_anti").withColumn(
        "request_path", api_path(F.col("composite_id")))
