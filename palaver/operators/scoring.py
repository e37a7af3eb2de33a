"""Composite suspicion score, the most suspect segment and a sample of its comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palaver.operators.scaling import z_scores

# Weight of each z-score. The anomaly value is high for normal authors, so
# its weight of 2 counts against it.
WEIGHTS = {
    "anomaly_score_val": -2.0,
    "repeated_ratio": 1.0,
    "link_ratio": 1.0,
    "lexical_diversity": -1.0,
    "comments_per_day": 1.0,
    "hour_entropy": -1.0,
}


def composite_score(scored: DataFrame) -> DataFrame:
    """Adds ``composite_score``; a column that ``scored`` lacks counts as constant."""
    absent = {c: F.lit(0.0) for c in WEIGHTS if c not in scored.columns}
    with_z = z_scores(scored.withColumns(absent) if absent else scored, list(WEIGHTS))
    terms = [F.col(f"z_{name}") * F.lit(weight) for name, weight in WEIGHTS.items()]
    return with_z.withColumn("composite_score", sum(terms[1:], terms[0])).drop(
        *[f"z_{name}" for name in WEIGHTS], *absent)


def segment_scores(composite: DataFrame) -> DataFrame:
    return composite.groupBy("segment").agg(F.avg("composite_score").alias("composite_score"))


def top_segment(composite: DataFrame) -> DataFrame:
    """The segment with the highest mean score as one row; ties go to the smaller number."""
    return segment_scores(composite).orderBy(F.desc("composite_score"), "segment").limit(1)


def _draw(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("comment_id").cast("string")))


#: Ids in one filter: as many as the Parquet reader compares with its statistics one by one.
_IDS_OF_A_FILTER = 10
#: Samples up to this size are fetched by their ids, larger ones by a join.
_FETCHED_BY_ID = 1_000


def drawn_suspects(comments: DataFrame, scored: DataFrame, top: DataFrame, size: int = 100, seed: int = 42) -> DataFrame:
    """Ids (and years) of a repeatable sample of comments by authors of the top segment, drawn from
    narrow columns."""
    members = scored.where(F.col("segment") == top.select("segment").scalar()).select("author_id")
    known = [c for c in ("comment_id", "year") if c in comments.columns]
    return comments.select("author_id", *known).join(members, "author_id", "left_semi").orderBy(
        _draw(seed), "comment_id").limit(size).select(*known)


def suspect_comments(
    comments: DataFrame, scored: DataFrame, top: DataFrame, size: int = 100, seed: int = 42
) -> DataFrame:
    """A repeatable sample of comments by authors of the top segment. Text is fetched only for the
    ``size`` comments drawn."""
    drawn = drawn_suspects(comments, scored, top, size, seed)
    wide = comments.select("author_id", "content", *drawn.columns)
    found = fetch_by_id(wide, drawn) if size <= _FETCHED_BY_ID else wide.join(drawn.select("comment_id"), "comment_id")
    return found.orderBy(_draw(seed), "comment_id").limit(size).select(
        F.col("author_id").alias("user_id"), F.col("content").alias("comment"))


def fetch_by_id(comments: DataFrame, drawn: DataFrame) -> DataFrame:
    """The comments with the ids of ``drawn``, a handful of rows (and their ``year``, if known).

    Years prune directories. Ids go into filters that the reader compares with the statistics and
    bloom filters of row groups, which tell them apart where comments are laid out by id.
    """
    ids_of: dict = {}
    for row in drawn.collect():
        ids_of.setdefault(row["year"] if "year" in drawn.columns else "any", []).append(row["comment_id"])
    parts = []
    for year, ids in sorted(ids_of.items(), key=str):
        ids.sort()
        of_year = F.lit(True) if year == "any" else F.col("year").eqNullSafe(F.lit(year))
        parts += [of_year & F.col("comment_id").isin(ids[i:i + _IDS_OF_A_FILTER]) for i in range(0, len(ids), _IDS_OF_A_FILTER)]
    if not parts:
        return comments.limit(0)
    found = comments.where(reduce(Column.__or__, parts))
    if all(len(ids) == len(set(ids)) for ids in ids_of.values()):
        return found
    # An id that was drawn more than once may be in two filters: its comments are found by both.
    times = reduce(Column.__add__, [part.cast("int") for part in parts])
    return found.select(*comments.columns, F.explode(F.sequence(F.lit(1), times)).alias("_time")).drop("_time")
