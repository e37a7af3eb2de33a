"""Jaccard join of documents on word shingles by token-combination prefixes.

A document's set is its distinct 5-word shingles, 64-bit tokens here. Sets are compared once per
distinct set, so copies cost a row each. All sets order their tokens alike, rare before frequent,
then by hash. Two sets that reach the threshold share a token among their first n - ceil(0.75 n) + 1
tokens, and k tokens if these prefixes are extended by k - 1. Here k is ``COMMON``, or the overlap that
the threshold asks for where that is less.

1. Frequent tokens come from counts inside chunks of all documents, summed over the corpus. They
   set bits of a bitmap of fixed size. The order only needs to be the same for all sets; a wrong
   bit costs time, not links. A text with a shared passage has its own words before it, so passages
   that thousands of documents share leave the index.
2. Extended prefixes are indexed. Tokens with one set drop out. In each bucket every set is verified
   against the bucket's smallest: no bucket is expanded to pairs, however large. Verified links give
   components.
3. Buckets whose sets are all in one component are done. All tokens that sets of two components share
   are in the others, the open ones. Every set's open tokens are ordered alike again, small buckets first.
   A pair across components is met at a token only if both sets have so many open tokens from there on as
   a link needs in common: at the first token that linked sets share, they have. In a large bucket
   (``RARE``) only sets of like size meet at all. Where buckets are crowded, they first meet a few centres of each
   (``CENTRES``): components that these links make one need not meet any more.

What a link needs: of the tokens that two linked sets share, at most those are outside of the extended
prefixes that lie behind one of them, so all others are in both (``least_common``). For sets of like size
that is far more than ``COMMON``. A pair whose extended prefixes have fewer tokens in common is no link. The
rest is verified on whole sets, which one document of each sends; a fixed-size bitmap says which.

Null, empty and wordless texts have empty sets and link with nothing; fewer than five words are one
shingle. Rows without an id keep their set size and have no component. Repeated rows each get their
row. Columns other than id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from palaver.llm import hashing
from palaver.llm.common import documents, map_batches, stage
from palaver.llm.graph import bitmap, components, rows_by_bit

WIDTH = 5
PERCENT = 75
#: Chunk counts that make a token frequent at least, and tokens that may be.
FREQUENT, MOST_FREQUENT = 16, 1 << 23
#: Sets in an open bucket that meet whatever their sizes.
RARE = 16
#: Sets in an open bucket, of one size band, that all others meet before all meet each other.
CENTRES = 8
#: Pairs in open buckets for each of their sets, from which on centres come first.
CROWDED = 32
#: Tokens that extended prefixes of two linked sets have in common at least, if the sets have so many.
COMMON = 32
#: Sets in a block of the verification.
BLOCK = 256
#: Tokens that are counted together in a task.
COUNTED = 1 << 22

_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: pa.Array, width: int = WIDTH):
    """(row, sorted distinct tokens) of every row."""
    for first, data, offsets in hashing.chunks(texts):
        word, row, _, _ = hashing.words(data, offsets, True)
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        n = len(word)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for j in range(width if n >= width else 0):
            rolled += word[j:n - width + 1 + j] * _FACTORS[j % 5]
        rolled = hashing.mix(rolled)
        for i in range(len(offsets) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                yield first + i, np.unique(rolled[a:b - width + 1])
            elif b > a:
                yield first + i, hashing.mix(np.array([(word[a:b] * _FACTORS[:b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield first + i, np.empty(0, np.uint64)


def digest(tokens: np.ndarray) -> int:
    """The node of a set: a 64-bit hash of its tokens."""
    if not len(tokens):
        return 0
    spread = hashing.mix(tokens * np.uint64(0x9FB21C651E98DF25) + np.uint64(len(tokens)))
    return int(hashing.mix(np.array([spread.sum(), np.bitwise_xor.reduce(spread)]) * _FACTORS[:2]).sum().view(np.int64))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def least_common(n: str, m: str, percent: int = PERCENT) -> Column:
    """Tokens that the extended prefixes of two sets of ``n`` and ``m`` tokens share at least, if they reach
    the threshold: all that the sets must share but what may lie behind the prefix that ends first."""
    overlap = F.ceil(percent * (F.col(n) + F.col(m)) / (100 + percent))
    return overlap - F.greatest(F.lit(0), F.ceil(percent * F.greatest(n, m) / 100) - COMMON)


def sets_and_counts(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row, and (token, n_chunk) of tokens that occur twice in a chunk."""

    def run(batches):
        held, size = [], 0

        def counted():
            tokens, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            tokens, n = tokens[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(tokens), pa.int64()), pa.array(n.astype(np.int64)), pa.array(tokens.view(np.int64)), pa.array(np.ones(len(tokens), bool))],
                names=["doc_id", "n", "node", "counts"])

        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, tokens in shingle_sets(batch.column("text"), width):
                n[i], node[i] = len(tokens), digest(tokens)
                held.append(tokens)
                size += len(tokens)
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(node), pa.array(np.zeros(len(n), bool))], names=["doc_id", "n", "node", "counts"])
        yield counted()

    both = stage(docs.mapInArrow(run, "doc_id long, n long, node long, counts boolean"), "sets")
    return (both.filter("NOT counts").select("doc_id", "n", "node"),
            both.filter("counts").select(F.col("node").alias("token"), F.col("n").alias("n_chunk")))


def frequent_tokens(counts: DataFrame) -> np.ndarray:
    """Bitmap of the tokens whose counts reach the least threshold that few enough tokens reach."""
    summed = stage(counts.groupBy("token").agg(F.sum("n_chunk").alias("n")).filter(F.col("n") >= FREQUENT), "frequent")
    by_size = summed.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect()  # at most 63 rows
    threshold, total = 1 << 62, 0
    for row in by_size:
        total += row["count"]
        if total > MOST_FREQUENT:
            break
        threshold = 1 << row["power"]
    return bitmap(summed.filter(F.col("n") >= threshold), "token")


def prefixes(docs: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """(token, node) of the extended prefixes of all sets."""

    def run(batch: pa.RecordBatch):
        bits = frequent.value
        tokens_out, nodes_out = [], []
        for _, tokens in shingle_sets(batch.column("text"), width):
            if len(tokens):
                late = hashing.set_bit(bits, tokens)
                ordered = np.concatenate([tokens[~late], tokens[late]]) if late.any() else tokens
                part = ordered[:prefix_size(len(tokens), percent) + COMMON - 1]
                tokens_out.append(part)
                nodes_out.append(np.full(len(part), digest(tokens), np.int64))
        if tokens_out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens_out).view(np.int64)), pa.array(np.concatenate(nodes_out))], names=["token", "node"])

    return map_batches(docs, run, "token long, node long")


def candidate_sets(docs: DataFrame, wanted, width: int) -> DataFrame:
    """(node, tokens) of the documents whose bit is set."""

    def run(batch: pa.RecordBatch):
        ids = batch.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)
        part = batch.filter(pa.array(hashing.set_bit(wanted.value, ids)))
        nodes, sets = [], []
        for _, tokens in shingle_sets(part.column("text"), width):
            if len(tokens):
                nodes.append(digest(tokens))
                sets.append(tokens.view(np.int64))
        if nodes:
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(sets)))], names=["node", "tokens"])

    return map_batches(docs, run, "node long, tokens array<long>")


def verified(docs: DataFrame, pairs: DataFrame, indexed: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that reach the threshold. ``indexed`` has every node's size, smallest
    document and indexed tokens: first the sizes, then the tokens in common of the extended prefixes
    must allow it, and only then whole sets are fetched, each from one document."""
    side = lambda end: indexed.select(*[F.col(c).alias(f"{c}_{end}") if c != "node" else F.col(c).alias(end) for c in ("node", "n", "first_doc", "tokens")])
    sized = stage(
        pairs.join(side("a"), "a").join(side("b"), "b")
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .filter(F.size(F.array_intersect("tokens_a", "tokens_b")) >= least_common("n_a", "n_b", percent))
        .select("a", "b", "n_a", "n_b", "first_doc_a", "first_doc_b"), "pairs")
    senders = sized.select(F.col("first_doc_a").alias("doc_id")).union(sized.select("first_doc_b")).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(senders, "doc_id"))
    sets = stage(candidate_sets(docs, wanted, width), "candidates")
    wanted.destroy()  # else every executor keeps it on its disk
    return stage(common_tokens(sized, sets).filter(
        100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b").distinct(), "edges")


def common_tokens(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n_a, n_b and ``common``, the tokens that the two sets share.

    Nodes are dealt to blocks of about ``BLOCK``. A pair of blocks is one task's work: it gets the sets
    that its pairs name once each, at most two blocks of them, so many pairs among a few thousand sets
    don't send a set for every pair.
    """
    blocks = max(1, -(-sets.count() // BLOCK))
    of = lambda end: F.pmod(F.xxhash64(end), F.lit(blocks)).cast("int")
    keyed = pairs.select("a", "b", "n_a", "n_b", F.least(of("a"), of("b")).alias("i"), F.greatest(of("a"), of("b")).alias("j"))
    named = keyed.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = named.join(sets.dropDuplicates(["node"]), "node").select(
        F.col("i").alias("block_i"), F.col("j").alias("block_j"), "node", "tokens")

    def count(pair_rows: pd.DataFrame, set_rows: pd.DataFrame) -> pd.DataFrame:
        known = {node: set(tokens.tolist()) for node, tokens in zip(set_rows["node"].tolist(), set_rows["tokens"])}
        shared = [len(known[a] & known[b]) for a, b in zip(pair_rows["a"].tolist(), pair_rows["b"].tolist())]
        return pair_rows[["a", "b", "n_a", "n_b"]].assign(common=np.array(shared, np.int64))

    return keyed.groupBy("i", "j").cogroup(sent.groupBy("block_i", "block_j")).applyInPandas(
        count, "a long, b long, n_a long, n_b long, common long")


def open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """token, node, n, root and bucket's size of (token, node, n), where a bucket has sets of several components."""
    placed = members.join(roots, "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).filter("low <> high")
    return stage(placed.join(several.select("token", "size"), "token"), "open")


def open_index(opened: DataFrame, percent: int) -> DataFrame:
    """(token, band, node, root, n, open) by which sets of different components meet; ``open`` is the number of a set's
    open tokens from that one on."""
    # A set with a link across has this many open tokens in common with another, whatever that one's size:
    # fewer rule it out, and of more the last ones can't be the first in common.
    least = F.least(F.lit(COMMON), F.ceil(percent * F.col("n") / 100)).cast("int")
    ranked = (opened.groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("size", "token"))).alias("open"))
              .filter(F.size("open") >= least))
    # Sizes that a link allows are in the same band or in the next; the sum is for rounding.
    band = F.when(F.col("x.size") > RARE, F.floor(F.log("n") / (math.log(100 / percent) + 1e-9))).otherwise(-9)
    first = F.slice("open", F.lit(1), F.size("open") - least + 1)
    return stage(ranked.select("node", "root", "n", F.size("open").alias("n_open"), F.posexplode(first).alias("at", "x"))
                 .select("x.token", band.alias("band"), "node", "root", "n", (F.col("n_open") - F.col("at")).alias("open")), "index")


def crowded(index: DataFrame) -> bool:
    """Whether buckets hold many pairs for each of their sets."""
    buckets = index.groupBy("token", "band").count().agg(F.sum("count").alias("sets"), F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs"))
    return buckets.filter(F.col("pairs") > CROWDED * F.col("sets")).count() > 0


def across(index: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of a set of ``index`` and one of ``some`` of its rows in different components that may be linked."""
    near = F.when(F.col("band") < 0, F.array("band")).otherwise(F.array(F.col("band") - 1, "band", F.col("band") + 1))
    other = some.select("token", F.explode(near).alias("band"), F.col("node").alias("b"), F.col("root").alias("root_b"),
                        F.col("n").alias("m"), F.col("open").alias("open_b"))
    ordered = F.lit(True) if some is not index else F.col("node") > F.col("b")
    return (index.join(other, ["token", "band"])
            .filter((F.col("root") != F.col("root_b")) & ordered & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
                    & (F.least("open", "open_b") >= least_common("n", "m", percent)))
            .select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct())


def link_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return set_classes(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def set_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The same with every row's ``node`` and its group's ``root``; components of clashing ids may share a component_id."""
    docs = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    spark = docs.sparkSession
    rows, counts = sets_and_counts(docs, width)
    nodes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"))
    nodes = stage(nodes, "nodes")
    frequent = spark.sparkContext.broadcast(frequent_tokens(counts))
    identified = docs.filter("doc_id IS NOT NULL")
    index = prefixes(identified, frequent, width, percent)
    shared = index.groupBy("token").agg(F.count("*").alias("rows")).filter("rows > 1")
    buckets = stage(index.join(shared.select("token"), "token").distinct(), "buckets")
    frequent.destroy()

    lists = buckets.groupBy("node").agg(F.collect_list("token").alias("tokens"))
    indexed = stage(nodes.join(lists, "node"), "indexed")
    smallest = buckets.groupBy("token").agg(F.min("node").alias("b"), F.count("*").alias("size")).filter("size > 1")
    star = buckets.join(smallest.select("token", "b"), "token").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    first_links = verified(identified, star, indexed, width, percent)

    roots = components(first_links)
    opened = open_buckets(buckets.join(nodes.select("node", "n"), "node"), roots)
    index = open_index(opened, percent)
    links, looked_at = first_links, star
    if crowded(index):
        chosen = Window.partitionBy("token", "band").orderBy(F.xxhash64("node", "token"))
        centres = index.withColumn("number", F.row_number().over(chosen)).filter(F.col("number") <= CENTRES)
        among = stage(across(index, centres, percent).join(star, ["a", "b"], "left_anti"), "among")
        links, looked_at = links.union(verified(identified, among, indexed, width, percent)), star.union(among)
        roots = components(links)
        index = open_index(open_buckets(opened.select("token", "node", "n"), roots), percent)
    more = across(index, index, percent).join(looked_at, ["a", "b"], "left_anti")
    second_links = verified(identified, more, indexed, width, percent)
    if not second_links.isEmpty():
        roots = components(links.union(second_links))
    labels = nodes.join(roots, "node", "left").select("node", "first_doc", F.coalesce("root", "node").alias("root"))
    least = labels.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = labels.join(least, "root").select("node", "root", "component_id")
    return (rows.withColumn("key", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("node")))
            .join(classes.withColumnRenamed("node", "key"), "key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), rows["node"], "root"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(documents(spark, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked texts the one of the smallest id stays; of linked or
    repeated rows of one id, one. Texts of one id that aren't linked stay all. Rows without an id stay."""
    classes = stage(set_classes(docs), "classes")
    # Names that no column of documents has, whatever extra columns there are.
    longest = "_" * max(map(len, docs.columns))
    number, kept_id, kept_node, root, node = (longest + c for c in ("n", "i", "k", "r", "s"))
    kept = classes.filter("doc_id = component_id").select(F.col("doc_id").alias(kept_id), F.col("node").alias(kept_node), F.col("root").alias(root)).distinct()
    repeated = classes.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter(F.col("count") > 1).select("doc_id")
    # Only rows that may go are shuffled; the others pass where they are read.
    doubtful = spark.sparkContext.broadcast(bitmap(classes.filter("doc_id <> component_id").select("doc_id").union(repeated).distinct(), "doc_id"))
    sure = rows_by_bit(docs, "doc_id", doubtful, False)
    chosen = rows_by_bit(docs, "doc_id", doubtful, True).withColumn(node, node_of("text"))
    chosen = chosen.join(kept, (chosen["doc_id"] == kept[kept_id]) & (chosen[node] == kept[kept_node]))
    # Texts without words are in no group: one row of each text.
    texts = F.sha2("text", 256)
    group = Window.partitionBy("doc_id", root, F.when(F.col(root).isNull(), texts), F.col(root).isNull() & F.col("text").isNull())
    first = chosen.withColumn(number, F.row_number().over(group.orderBy(texts))).filter(F.col(number) == 1).select(*docs.columns)
    return sure.unionByName(first)


@F.pandas_udf(T.LongType())
def node_of(texts: pd.Series) -> pd.Series:
    """The node of every text's set."""
    nodes = np.zeros(len(texts), np.int64)
    for i, tokens in shingle_sets(pa.array(texts, pa.string(), from_pandas=True), WIDTH):
        nodes[i] = digest(tokens)
    return pd.Series(nodes)
