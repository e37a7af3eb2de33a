"""Comment order within an author, without ever holding an author's comments in one task.

Comments first collapse to distinct moments (author, microsecond), so that copies of a moment are
one row. Moments are range partitioned by author and time and sorted: an author with a third of
all comments lies in many partitions that follow each other. Every moment finds the one before it
inside its partition, and the first of a partition in the last row of the partition before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from palaver.functions.text import fingerprint
from palaver.functions.time import MICROS_PER_HOUR, micros
from palaver.session import stage


def _hours(micro_gap: Column) -> Column:
    return micro_gap.cast("double") / F.lit(float(MICROS_PER_HOUR))


def _moments(comments: DataFrame) -> DataFrame:
    """Distinct moments: ``author_id``, ``at`` (microseconds), ``copies``, smallest ``lead_id``."""
    dated = comments.where("author_id is not null and creation_datetime is not null")
    return dated.groupBy("author_id", micros(F.col("creation_datetime")).alias("at")).agg(
        F.count("*").alias("copies"), F.min("comment_id").alias("lead_id"))


def _look_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``previous``, the author's moment before, and the partition's number ``part``."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        authors, at = batch.column("author_id").to_numpy(), batch.column("at").to_numpy()
        before_author, before_at = np.roll(authors, 1), np.roll(at, 1)
        known = authors == before_author
        known[0] = last is not None and last[0] == authors[0]
        if last is not None:
            before_at[0] = last[1]
        last = authors[-1], at[-1]
        yield batch.append_column("previous", pa.array(before_at, mask=~known)).append_column(
            "part", pa.array(np.full(len(at), part, np.int32)))


def _stitches(ordered: DataFrame) -> DataFrame | None:
    """(author_id, at, stitched) of the moments whose predecessor ends the partition before. The
    driver gets one row per partition."""
    edges = ordered.groupBy("part").agg(
        F.min(F.struct("author_id", "at")).alias("first"), F.max(F.struct("author_id", "at")).alias("last")).orderBy("part").collect()
    seams = [(b["first"]["author_id"], b["first"]["at"], a["last"]["at"]) for a, b in zip(edges, edges[1:])
             if a["last"]["author_id"] == b["first"]["author_id"]]
    return ordered.sparkSession.createDataFrame(seams, "author_id long, at long, stitched long") if seams else None


def moments_in_order(comments: DataFrame) -> DataFrame:
    """Distinct moments of each author with the ``previous`` one, null for the first."""
    kind = "author_id long, at long, copies long, lead_id long"
    moments = _moments(comments).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in kind.split(", ")])
    keys = ["author_id", "at"]
    ordered = stage(
        moments.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
            _look_back, f"{kind}, previous long, part int"), "moments")
    seams = _stitches(ordered)
    if seams is None:
        return ordered.drop("part")
    return ordered.join(F.broadcast(seams), keys, "left").withColumn(
        "previous", F.coalesce("previous", "stitched")).drop("stitched", "part")


def comment_gaps(comments: DataFrame) -> DataFrame:
    """Hours since the author's previous comment; null for the first one.

    The first comment of a moment carries the gap to the previous moment; its companions
    at the same moment have gap 0. They meet again on ``comment_id``, which is unique.
    """
    leads = moments_in_order(comments).select(
        "lead_id", F.lit(True).alias("leads"), _hours(F.col("at") - F.col("previous")).alias("lead_gap"))
    gap = (
        F.when(F.col("creation_datetime").isNull(), F.lit(None))
        .when(F.col("leads"), F.col("lead_gap"))
        .otherwise(F.lit(0.0))
    )
    named = comments.where("author_id is not null").select(
        "author_id", "comment_id", "creation_datetime")
    return named.join(leads, F.col("comment_id") == F.col("lead_id"), "left").select(
        "author_id", "comment_id", gap.alias("gap_hours"))


def burstiness(comments: DataFrame) -> DataFrame:
    """Sample standard deviation of the gaps in hours, per author with any timestamp.

    0 for a single comment, null for two. Gaps between moments and the zero gaps of simultaneous
    comments are two groups, whose squared deviations from the common mean add up; both come from
    one aggregate that combines before the shuffle.
    """
    gap = _hours(F.col("at") - F.col("previous"))
    per_author = moments_in_order(comments).groupBy("author_id").agg(
        F.count(gap).alias("gaps"), F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_gap"),
        F.coalesce(F.var_pop(gap), F.lit(0.0)).alias("variance"), F.sum(F.col("copies") - 1).alias("zeros"))
    total = F.col("gaps") + F.col("zeros")
    mean = F.try_divide(F.col("gaps") * F.col("mean_gap"), total)
    squares = F.col("gaps") * (F.col("variance") + F.pow(F.col("mean_gap") - mean, 2)) + F.col("zeros") * F.pow(mean, 2)
    value = F.when(total == 0, 0.0).when(total > 1, F.sqrt(squares / (total - 1)))
    return per_author.select("author_id", value.alias("burstiness_hours"))


def duplicate_flags(comments: DataFrame) -> DataFrame:
    """Marks every comment that repeats an earlier text of its author.

    The first comment per (author, text) is a minimum, which combines before the shuffle;
    a window would gather all copies of a text in one task.
    """
    named = comments.where("author_id is not null")
    firsts = named.groupBy("author_id", fingerprint(F.col("content")).alias("text")).agg(
        F.min(F.struct("creation_datetime", "comment_id"))["comment_id"].alias("first_id")
    ).select("first_id")
    return named.select("author_id", "comment_id").join(
        firsts, F.col("comment_id") == F.col("first_id"), "left"
    ).select("author_id", "comment_id", F.col("first_id").isNull().alias("is_repeat"))
