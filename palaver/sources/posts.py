"""Posts: one JSON document per day, ``api_date_*.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palaver.functions.media import stream_uri
from palaver.functions.text import words
from palaver.schemas import POSTS, RAW_POST_DAY

FILE_PATTERN = "api_date_*.json"


def read_post_days(spark: SparkSession, root: str) -> DataFrame:
    """One row per day file: ``file``, ``items`` and ``_corrupt_record``."""
    return with_file_name(
        spark.read.schema(RAW_POST_DAY)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", FILE_PATTERN)
        .json(root)
    )


def with_file_name(days: DataFrame) -> DataFrame:
    return days.select(F.col("_metadata.file_name").alias("file"), "items", "_corrupt_record")


def flatten_posts(days: DataFrame) -> DataFrame:
    """One row per post with a non-empty id, plus the ``file`` it came from and its place there."""
    item = days.select("file", F.posexplode("items").alias("pos", "p")).where("p.id <> ''")
    timestamps = {"published_at", "created_at", "date"}
    derived = {
        "tags": words(F.col("p.tags")),
        "stream_uri": stream_uri(F.col("p.media_type"), F.col("p.media")),
        "kudos_total": F.col("p.stats.kudos_total"),
        "views_total": F.col("p.stats.views_total"),
        "stats_id": F.col("p.stats.id"),
    }

    def field(name: str):
        if name in timestamps:
            return F.col(f"p.{name}").try_cast("timestamp_ntz")
        return derived.get(name, F.col(f"p.{name}"))

    return item.select("file", "pos", *[field(n).alias(n) for n in POSTS.names])


def post_errors(days: DataFrame) -> DataFrame:
    """Files that are not JSON, of which the reader fills no field, and files with a value of the
    wrong type, whose posts load with a hole."""
    reason = F.when(F.col("items").isNull(), "unreadable").otherwise("wrong type")
    return days.where("_corrupt_record is not null").select("file", reason.alias("reason"))
