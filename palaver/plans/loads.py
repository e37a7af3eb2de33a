"""Whole loads from raw documents to stored tables, one function per table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from palaver.operators import keys
from palaver.operators.threads import flatten_documents
from palaver.schemas import AUTHOR_USERNAMES, AUTHORS, COMMENTS, COMMENTS_RAW, POSTS
from palaver.session import stage
from palaver.sources import authors as author_source, comments as comment_source
from palaver.sources import posts as post_source, tables
from palaver.sources.snapshots import Change, Store


def _typed(df: DataFrame, schema: StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def load_posts(store: Store, root: str, table: str = "posts") -> DataFrame:
    """Append the posts of all day files that the table does not hold; the first file wins."""
    batch = post_source.flatten_posts(post_source.read_post_days(store.spark, root))
    return tables.append_new(store, table, batch, POSTS, "id", ["file", "pos"])


@dataclass
class Crawl:
    """Documents that were opened and parsed once, and all that is taken from them."""

    documents: DataFrame
    flat: DataFrame

    @property
    def comments(self) -> DataFrame:
        return self.flat.select(*COMMENTS.names)

    @property
    def sightings(self) -> DataFrame:
        return author_source.sightings_of(self.documents)

    def ledger(self) -> DataFrame:
        """One row per file, whether or not anything came from it: ``path``, ``file``, ``year``,
        ``comments`` (``loaded``, ``empty`` or why not), ``rows_loaded``, and its author entries:
        ``sightings`` and how many of them are without id, name or day."""
        status = comment_source.document_status(self.documents)
        counts = self.flat.groupBy("path").agg(F.count("*").alias("rows_loaded"))
        done = F.when(F.col("comments") != "loads", F.col("comments")).when(F.col("rows_loaded") > 0, "loaded").otherwise("empty")
        return status.join(counts, "path", "left").withColumn("rows_loaded", F.coalesce("rows_loaded", F.lit(0))).select(
            "path", "file", "year", done.alias("comments"), "rows_loaded", "sightings", "without_id", "without_name", "without_day")


def read_crawl(spark: SparkSession, root: str, years: Iterable[int] | None = None) -> Crawl:
    """The documents below ``root``, of some years or of all, opened and parsed in one pass."""
    return crawl_of(stage(comment_source.open_documents(comment_source.read_documents(spark, root, years)), "documents"))


def crawl_of(opened: DataFrame) -> Crawl:
    """A crawl from documents that ``compact_documents`` has kept."""
    return Crawl(opened, flatten_documents(opened, comment_source.parsed))


def read_comments(
    spark: SparkSession, root: str, years: Iterable[int] | None = None
) -> DataFrame:
    """Flat comments of the documents below ``root``, of some years or of all."""
    return read_crawl(spark, root, years).comments


def load_comments(store: Store, crawl: Crawl, table: str = "comments") -> DataFrame:
    """Insert all comments or, if any key is null or taken, none."""
    tables.bulk_insert_comments(store, table, crawl.comments)
    return store.read(table, COMMENTS)


def reload_comments_raw(store: Store, crawl: Crawl, table: str = "comments_raw", markers: str = "load_markers") -> DataFrame:
    """Reset the raw comment table, its load markers and the ledger in one commit.

    A null id is skipped; of equal ids the one from the earliest year is kept.
    """
    once = keys.first_per_key(
        crawl.comments.where("comment_id is not null"), ["comment_id"],
        ["year", "post_id", "depth", "parent_comment_id", "creation_datetime", "content"])
    ledger = stage(crawl.ledger(), "ledger")
    store.commit(
        Change(table, _typed(once, COMMENTS_RAW), replace=True),
        Change(markers, tables.year_markers(ledger), replace=True),
        Change("ledger", ledger, replace=True))
    return store.read(table, COMMENTS_RAW)


def _upserted(sightings: DataFrame, stored: DataFrame, rules) -> DataFrame:
    batch = keys.canonical_authors(sightings.where("author_id is not null"))
    return _typed(keys.upsert(stored, batch, "id", rules), AUTHORS)


def load_authors(store: Store, root: str, table: str = "authors") -> DataFrame:
    """The author table after the sightings below ``root``; the stored registration stays.

    Apply batches in the order in which later ones should win.
    """
    sightings = author_source.read_author_sightings(store.spark, root)
    store.commit(Change(table, _upserted(sightings, store.read(table, AUTHORS), keys.KEEP_REGISTRATION), replace=True))
    return store.read(table, AUTHORS)


def merge_sightings(store: Store, sightings: DataFrame, table: str = "authors", names: str = "author_usernames") -> tuple[DataFrame, DataFrame]:
    """Authors and username history after a table of sightings, in one commit; the earliest
    registration stays. Sightings without a name or a day add nothing to the history: a crawl's
    ledger counts them."""
    history = store.read(names, AUTHOR_USERNAMES)
    store.commit(
        Change(table, _upserted(sightings, store.read(table, AUTHORS), keys.EARLIEST_REGISTRATION), replace=True),
        Change(names, _typed(keys.new_usernames(history, sightings), AUTHOR_USERNAMES)))
    return store.read(table, AUTHORS), store.read(names, AUTHOR_USERNAMES)


def ledger_errors(ledger: DataFrame) -> DataFrame:
    """``file``, ``reason`` of everything that a crawl's ledger says was left out."""
    reasons = F.array(
        F.when(~F.col("comments").isin("loaded", "empty"), F.col("comments")),
        F.when(F.col("without_id") > 0, "author without id"), F.when(F.col("without_name") > 0, "author without name"),
        F.when(comment_source.day_in_name().isNull(), "no day in name"))
    return ledger.select("file", F.explode(F.array_compact(reasons)).alias("reason"))


def ingest_errors(spark: SparkSession, posts_root: str, comments_root: str) -> DataFrame:
    """Every file of which a load leaves something out, with the reason: ``file``, ``reason``."""
    return post_source.post_errors(post_source.read_post_days(spark, posts_root)).unionByName(
        ledger_errors(read_crawl(spark, comments_root).ledger()))
