"""Loads by key: uniqueness checks, insert-or-ignore, upserts, canonical authors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are null or occur more than once, with their number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("copies")).where(
        F.col(key).isNull() | (F.col("copies") > 1))


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """First row of each key in ``order_by`` order.

    Spark limits each key to one row before the shuffle (WindowGroupLimit), so a key with
    very many copies never gathers in one task.
    """
    place = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")


def insert_ignore(
    stored: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Rows of ``batch`` to add: non-null keys that ``stored`` lacks, first copy of each.

    Copies go first, so the anti join meets each key once and reuses the partitioning.
    """
    present = batch.where(" and ".join(f"{k} is not null" for k in keys))
    single = first_per_key(present, keys, order_by)
    return single.join(stored.select(*keys), list(keys), "left_anti").select(*batch.columns)


# How a stored and an incoming value of one column combine. Each is used only where both
# sides hold the key; a row on one side alone is kept as it is.
RULES = {
    "new": lambda old, new: new,
    "or": lambda old, new: old | new,
    "least": F.least,
    "greatest": F.greatest,
    "old_else_new": F.coalesce,
}

_AUTHOR_RULES = {
    "username": "new",
    "active": "new",
    "newbie": "new",
    "banned": "or",
    "premium": "or",
    "first_seen_at": "least",
    "last_seen_at": "greatest",
}
KEEP_REGISTRATION = {**_AUTHOR_RULES, "registered_at": "old_else_new"}
EARLIEST_REGISTRATION = {**_AUTHOR_RULES, "registered_at": "least"}


def upsert(stored: DataFrame, batch: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """New state of the table. Both sides must be unique by ``key``.

    Batches are applied in the caller's order: the later batch wins where the rule is "new".
    """
    old = stored.withColumn("_held", F.lit(True)).alias("old")
    new = batch.withColumn("_sent", F.lit(True)).alias("new")

    def merged(name: str) -> Column:
        a, b = F.col(f"old.{name}"), F.col(f"new.{name}")
        if name == key:
            return F.coalesce(a, b)
        return (
            F.when(F.col("_held").isNull(), b)
            .when(F.col("_sent").isNull(), a)
            .otherwise(RULES[rules[name]](a, b))
        )

    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(
        *[merged(name).alias(name) for name in stored.columns])


def canonical_authors(sightings: DataFrame) -> DataFrame:
    """One row per author: latest known profile, sticky flags, first and last sighting.

    Equal profiles collapse first, in a hash aggregate that combines before the shuffle,
    so that the per-author step sees an author's few distinct profiles and not all
    sightings.
    """
    profile = ["author_id", "username", "active", "newbie", "banned", "premium", "registered_at"]
    profiles = sightings.groupBy(*profile).agg(
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))

    def latest(name: str) -> Column:
        known = F.when(F.col(name).isNotNull(), F.struct("last_seen", name))
        return F.max(known)[name].alias(name)

    return profiles.groupBy(F.col("author_id").alias("id")).agg(
        latest("username"),
        latest("active"),
        latest("newbie"),
        F.bool_or("banned").alias("banned"),
        F.bool_or("premium").alias("premium"),
        latest("registered_at"),
        F.min("first_seen").alias("first_seen_at"),
        F.max("last_seen").alias("last_seen_at"),
    )


def new_usernames(history: DataFrame, sightings: DataFrame) -> DataFrame:
    """(author, name, day) triples that the username history lacks."""
    keys = ["author_id", "username", "seen_at"]
    seen = sightings.select(*keys).dropna().distinct()
    return seen.join(history.select(*keys), keys, "left_anti")
