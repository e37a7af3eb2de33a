"""Resumable loads: the stream remembers which files it has read, the keys which rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.schemas import POSTS, RAW_POST_DAY
from palaver.sources.posts import FILE_PATTERN, flatten_posts, with_file_name
from palaver.sources.snapshots import Store
from palaver.sources.tables import add_new


def ingest_posts(
    spark: SparkSession, root: str, store: Store, checkpoint: str, files_per_batch: int = 10_000,
    table: str = "posts",
) -> None:
    """Load every new day file below ``root`` into a table of the store and stop.

    A repeated micro-batch adds nothing, because known ids are left out before the append.
    """

    def load(batch: DataFrame, _: int) -> None:
        add_new(store, table, flatten_posts(batch), POSTS, "id", ["file", "pos"])

    days = with_file_name(
        spark.readStream.schema(RAW_POST_DAY)
        .option("multiLine", True)
        .option("pathGlobFilter", FILE_PATTERN)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(root)
    )
    days.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
