"""Reply trees: from nested documents to rows, and depth and root over stored rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palaver.schemas import COMMENTS
from palaver.session import stage

#: Steps of a round. Documents that are deeper than those of the first go on with twice as many.
STEPS = 32
#: Tree levels that a step reads at once, at first and in deep documents: more are fewer looks into
#: the document, but a larger plan.
STEP_LEVELS = 2
DEEP_STEP_LEVELS = 8

_FIELDS = {
    "comment_id": ("id", "bigint"),
    "author_id": ("author", "bigint"),
    "creation_datetime": ("creation_datetime", "string"),
    "content": ("content", "string"),
    "kudos_count": ("kudos_count", "int"),
    "approved": ("approved", "boolean"),
    "reference_id": ("reference_id", "bigint"),
}
_FRONTIER = "array<struct<depth: int, parent_comment_id: bigint, at: string>>"
_FOUND = "array<struct<parent_comment_id: bigint, depth: int, " + ", ".join(
    f"{name}: {kind}" for name, (_, kind) in _FIELDS.items()) + ">>"


def _node_type(levels: int) -> str:
    """A comment with so many levels; of the replies below only the number is read."""
    fields = ", ".join(f"{key}: {kind}" for key, kind in _FIELDS.values())
    replies = _node_type(levels - 1) if levels > 1 else "struct<id: bigint>"
    return f"struct<{fields}, child_comments: array<{replies}>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _replies(level: Column) -> Column:
    """The replies to a level's comments, none where they are no array, and the path of each."""
    return F.flatten(F.filter(
        F.transform(level, lambda x: F.transform(x["node"]["child_comments"], lambda c, i: F.struct(
            (x["depth"] + 1).alias("depth"), x["node"]["id"].alias("parent_comment_id"), c.alias("node"),
            F.concat(x["at"], F.lit(".child_comments["), i.cast("string"), F.lit("]")).alias("at")))),
        lambda found: found.isNotNull()))


def _rows(level: Column) -> Column:
    return F.transform(level, lambda x: F.struct(x["parent_comment_id"], x["depth"], *[
        x["node"][key].alias(name) for name, (key, _) in _FIELDS.items()]))


def _step(doc: Column, frontier: Column, levels: int) -> Column:
    """The comments of the next ``levels`` levels, and the frontier below them."""
    kind = F.lit(_node_type(levels))
    top = F.transform(frontier, lambda x: F.struct(
        x["depth"], x["parent_comment_id"], F.call_function("try_variant_get", doc, x["at"], kind).alias("node"), x["at"]))

    def down(level: Column, found: list[Column], number: int) -> Column:
        rows = [*found, _rows(level)]
        if number < levels:
            return _let(_replies(level), lambda lower: down(lower, rows, number + 1))
        below = F.transform(_replies(level), lambda x: F.struct(x["depth"], x["parent_comment_id"], x["at"]))
        return F.struct(below.cast(_FRONTIER).alias("frontier"), F.concat(*rows).cast(_FOUND).alias("found"))

    return _let(top, lambda level: down(level, [], 1))


def first_frontier(doc: Column) -> Column:
    """The paths of the topmost comments of a document."""
    places = F.size(F.coalesce(
        F.try_variant_get(doc, "$.comments", "array<struct<id: bigint>>"), F.array().cast("array<struct<id: bigint>>")))
    return F.transform(
        F.when(places > 0, F.sequence(F.lit(0), places - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent_comment_id"),
                           F.concat(F.lit("$.comments["), i.cast("string"), F.lit("]")).alias("at"))).cast(_FRONTIER)


def walk(doc: Column, frontier: Column, steps: int, levels: int = STEP_LEVELS) -> Column:
    """The comments ``found`` at a frontier and below it, and the ``frontier`` after so many steps.

    One expression goes down a whole document, ``levels`` levels a step, in a plan that does
    not grow with the depth. What lies below is named by its path and read in place, so no part of
    a document is copied and no depth costs stack. At any depth a field of the wrong type is null,
    and a node that is no object has no fields. The document is bound before the first step: as a mere column
    it may be put in place of its name by the optimizer, and be parsed at every step.
    """
    return _let(doc, lambda whole: F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(frontier.alias("frontier"), F.array().cast(_FOUND).alias("found")),
        lambda state, _: F.when(F.size(state["frontier"]) == 0, state).otherwise(_let(
            _step(whole, state["frontier"], levels), lambda done: F.struct(
                done["frontier"].alias("frontier"), F.concat(state["found"], done["found"]).alias("found"))))))


def flatten_documents(opened: DataFrame, parse: Callable[[str], Column]) -> DataFrame:
    """Rows of the comment table, and the ``path`` each comes from, of opened documents: ``path``,
    ``post_id``, ``year``, the comments ``found`` so far and, where a ``frontier`` is left, the ``text``.

    One ``explode`` makes the rows, no shuffle. Documents with a frontier are dealt anew, for they
    take long, are parsed again and go on with twice the steps, so a tree of depth d takes
    log2(d / 256) rounds more.
    """
    pieces, steps, rest = [opened], STEPS, opened
    tasks = int(opened.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while not (rest := rest.where(F.size("frontier") > 0)).isEmpty():
        dealt = rest.repartition(tasks, F.xxhash64("path")).withColumn("doc", parse("text"))
        walked = dealt.withColumn("walked", walk(F.col("doc"), F.col("frontier"), steps, DEEP_STEP_LEVELS))
        rest = stage(walked.select(
            "path", "post_id", "year", "walked.found", "walked.frontier",
            F.when(F.size("walked.frontier") > 0, F.col("text")).alias("text")), "walked")
        pieces.append(rest)
        steps *= 2
    time = F.col("creation_datetime").try_cast("timestamp_ntz")
    rows = [p.where("post_id IS NOT NULL AND year IS NOT NULL").select("path", "post_id", "year", F.explode("found").alias("found")) for p in pieces]
    return reduce(DataFrame.unionByName, rows).select("path", "post_id", "year", "found.*").withColumn(
        "creation_datetime", time).select(*COMMENTS.names, "path")


def _settled(rounds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.where("settled") for r in rounds])


def thread_depth(comments: DataFrame) -> DataFrame:
    """Depth, root and number of direct replies of every stored comment.

    Pointer doubling: each round replaces a comment's pointer by its pointer's pointer, so
    a thread of depth d takes log2(d) joins, and only comments that have not reached
    their root are joined and written again. The join side that may repeat a hot parent
    feeds a write, so adaptive execution may split it. A comment whose parent is not
    stored starts its own thread.
    """
    links = comments.select("comment_id", "parent_comment_id")
    ids = links.select(F.col("comment_id").alias("known_id"))
    held = links.join(ids, F.col("parent_comment_id") == F.col("known_id"), "left")
    rounds = [stage(held.select(
        "comment_id",
        F.coalesce("known_id", "comment_id").alias("up"),
        F.col("known_id").isNotNull().cast("bigint").alias("steps"),
        F.col("known_id").isNull().alias("settled"),
    ), "pointers")]
    while not (moving := rounds[-1].where("not settled")).isEmpty():
        if rounds[-1].where("settled").isEmpty():
            # Below a root, every doubling settles the comments just out of reach before.
            raise ValueError("the parent links contain a cycle")
        above = _settled(rounds).unionByName(moving).select(
            F.col("comment_id").alias("at"), F.col("up").alias("next_up"),
            F.col("steps").alias("next_steps"), F.col("settled").alias("next_settled"))
        rounds.append(stage(moving.join(above, F.col("up") == F.col("at")).select(
            "comment_id",
            F.col("next_up").alias("up"),
            (F.col("steps") + F.col("next_steps")).alias("steps"),
            F.col("next_settled").alias("settled"),
        ), "pointers"))
    replies = (
        links.where("parent_comment_id is not null")
        .groupBy(F.col("parent_comment_id").alias("comment_id"))
        .agg(F.count("*").alias("replies"))
    )
    return _settled(rounds).join(replies, "comment_id", "left").select(
        "comment_id",
        F.col("up").alias("root_id"),
        F.col("steps").alias("depth"),
        F.coalesce("replies", F.lit(0)).alias("replies"),
    )
