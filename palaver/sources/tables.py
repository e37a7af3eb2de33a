"""Keyed loads into stored tables, and report files."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from palaver.operators.keys import duplicate_keys, insert_ignore
from palaver.schemas import COMMENTS
from palaver.sources.snapshots import Change, Store


def append_new(
    store: Store, table: str, batch: DataFrame, schema: StructType, key: str, order_by: list[str]
) -> DataFrame:
    """``add_new``, and the table as it is then."""
    add_new(store, table, batch, schema, key, order_by)
    return store.read(table, schema)


def add_new(store: Store, table: str, batch: DataFrame, schema: StructType, key: str, order_by: list[str]) -> None:
    """Append rows whose key the table does not hold yet; repeating a batch adds nothing.

    Of the stored keys only those that the batch has, too, are held against it: the side that
    Spark may broadcast is never larger than the batch, however large the table. From time to time the
    keys of all folders are stored together, so that a batch after many others opens few folders.
    """
    sent = batch.select(key).where(F.col(key).isNotNull()).distinct()
    stored = store.keys(table, schema, key)
    fresh = insert_ignore(stored.rows.join(sent, key, "left_semi"), batch, [key], order_by)
    store.commit(Change(table, fresh.select(*schema.names)), *stored.gathered())


#: Writer options of the comment table: a filter per row group says whether an id can be in it.
COMMENT_OPTIONS = {"parquet.bloom.filter.enabled#comment_id": "true", "parquet.bloom.filter.expected.ndv#comment_id": "100000"}


def laid_out(comments: DataFrame) -> DataFrame:
    """Comments in the order of year and id, in ranges, so that a file has one year and few ids lie
    in many row groups."""
    return comments.repartitionByRange("year", "comment_id").sortWithinPartitions("year", "comment_id")


def bulk_insert_comments(store: Store, table: str, batch: DataFrame) -> None:
    """Insert all comments or none: any null or repeated key refuses the whole batch, and a load
    that dies publishes nothing."""
    stored = store.read(table, COMMENTS)
    both = stored.select("comment_id").unionAll(batch.select("comment_id"))
    bad = duplicate_keys(both, "comment_id").limit(1).collect()
    if bad:
        raise ValueError(f"comment_id {bad[0]['comment_id']} is null or not unique")
    store.commit(Change(table, laid_out(batch), partition_by=("year",), options=COMMENT_OPTIONS))


def load_markers(comments: DataFrame) -> DataFrame:
    """Rows loaded per year, stamped with the load time."""
    return _stamped(comments.groupBy("year").agg(F.count("*").alias("rows_loaded")))


def year_markers(ledger: DataFrame) -> DataFrame:
    """Files and rows loaded per year from the ledger of a load: a year whose files hold no
    comment has a marker, too."""
    return _stamped(ledger.where("year IS NOT NULL").groupBy("year").agg(
        F.sum("rows_loaded").alias("rows_loaded"), F.count("*").alias("files")))


def _stamped(markers: DataFrame) -> DataFrame:
    return markers.withColumn("loaded_at", F.current_timestamp().cast("timestamp_ntz"))


def write_report(report: DataFrame, path: str) -> None:
    """A report has a fixed number of rows (segments, metrics or sample), so one file."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_rows(df: DataFrame, path: str) -> None:
    """Per-author output: as many files as there are partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_reports(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Reports that exist and can be read, by path. Types are inferred: reports are small."""
    found = {}
    for path in paths:
        try:
            found[path] = spark.read.option("header", True).option("inferSchema", True).csv(path)
        except AnalysisException:
            logging.getLogger(__name__).warning("skipping %s", path)
    return found


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
