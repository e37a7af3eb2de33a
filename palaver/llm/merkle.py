"""A Merkle manifest of a dataset: a hash tree per language and one over the languages.

The tree is kept in aligned blocks of ``2 ** BLOCK_LEVELS`` consecutive nodes. A round turns every
block into the nodes of its next levels and hands the topmost one to the round above, so that a
tree of n leaves takes log2(n) / BLOCK_LEVELS shuffles and no task ever holds more than one block.
Nodes are never rewritten. A tampered leaf makes a version: copies of the nodes on its way to the
root, everything else shared with version 0. The copies are made block by block, first those in the
leaf's own block, then those above, whose siblings come down to each block as one path.

Leaves are ordered by id in a range partitioning; their places come from counts per partition.
Rows of one id are ordered by their leaf, equal rows by their place in the input. A null in a
column counts as ``-``, a null id stands first and is never tampered with, languages that are null
come first. An empty table has no leaves and no root. Columns other than FIELDS are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palaver.llm.common import documents, stage

#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of one block; a block has 256 nodes at its bottom.
BLOCK_LEVELS = 8
BLOCK = 1 << BLOCK_LEVELS
_ROWS_OF_PARTITION = 1 << 33

_STEP = "array<struct<on_left: boolean, digest: string>>"


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """Digest of a row, some of whose columns may be changed."""
    return sha(F.concat(*[_field(changed.get(name, F.col(name))) for name in FIELDS]))


def _quote(name: Column) -> Column:
    """A tree's name as text that sorts null first and then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), name), F.lit("-"))


def placed(rows: DataFrame, order_by: tuple[str, ...]) -> DataFrame:
    """Adds ``pos``, a row's place from 0 among those of its ``tree``.

    Rows are range partitioned and sorted; a partition's rows of a tree follow those of the
    partitions before it. Equal rows are told apart by their place in the input, so that no
    number of them ends in one task.
    """
    numbered = rows.withColumn("input_place", F.monotonically_increasing_id())
    keys = ["tree", *order_by, "input_place"]
    ordered = stage(
        numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("input_place")
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.floor(F.col("at") / _ROWS_OF_PARTITION)), "ordered")
    runs = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumns({
        "before": F.expr("sum(n) OVER (PARTITION BY tree ORDER BY part) - n"),
        "size": F.expr("sum(n) OVER (PARTITION BY tree)")})
    return ordered.join(stage(runs, "runs"), ["tree", "part"]).withColumn(
        "pos", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before", "n")


def _height(size: Column) -> Column:
    """Levels above the leaves until one node is left."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("int")


def _next_level(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(runs, lambda i: sha(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit("")))))


@dataclass
class Forest:
    """Hash trees in blocks, from the leaves' round to the topmost.

    A block has its ``tree``, ``block`` number, the tree's ``height``, ``levels`` (arrays of
    digests, from BLOCK nodes to one) and in the first round its ``members``. ``roots`` has
    ``tree`` and ``digest``.
    """

    rounds: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.rounds[-1].select("tree", F.get(F.get("levels", F.lit(BLOCK_LEVELS)), F.lit(0)).alias("digest"))

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, block, path, ...) of the first round's blocks: the siblings above a block, going
        on with the ``path`` that ``above`` has for each tree, whose other columns come along."""
        known = above.withColumn("block", F.lit(0).cast("long"))
        extra = [c for c in known.columns if c not in ("tree", "block", "path")]
        for number in range(len(self.rounds) - 1, 0, -1):
            bottom = F.get("levels", F.lit(0))
            below = self.rounds[number].join(known, ["tree", "block"]).select(
                "tree", "path", *extra, F.col("block").alias("parent"),
                F.posexplode(F.transform(bottom, lambda _, i: siblings(F.col("levels"), i, F.col("height"), number))).alias("i", "own"))
            known = stage(below.select(
                "tree", (F.col("parent") * BLOCK + F.col("i")).alias("block"), F.concat("own", "path").alias("path"), *extra), "paths")
        return known


def siblings(levels: Column, i: Column, height: Column, number: int) -> Column:
    """Siblings of place ``i`` of a block of round ``number``, bottom up; a null digest where the run has no other."""
    steps = F.array(*[
        F.struct(
            (F.floor(i / (1 << k)) % 2 == 1).alias("on_left"),
            F.get(F.get(levels, F.lit(k)), (F.floor(i / (1 << k)) + F.lit(1) - 2 * (F.floor(i / (1 << k)) % 2)).cast("int")).alias("digest"))
        for k in range(BLOCK_LEVELS)])
    return F.slice(steps, F.lit(1), F.greatest(F.lit(0), F.least(F.lit(BLOCK_LEVELS), height - BLOCK_LEVELS * number)))


def grow(nodes: DataFrame) -> Forest:
    """Trees over ``nodes``: tree, pos, digest, size (leaves of the tree) and ``member``, a struct that
    stays with a node of the first round."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    current = nodes.select("tree", "pos", "digest", "member", _height(F.col("size")).alias("height"))
    rounds: list[DataFrame] = []
    while True:
        base = BLOCK_LEVELS * len(rounds)
        kept = F.struct("pos", "digest", "member") if "member" in current.columns else F.struct("pos", "digest")
        members = current.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
            F.sort_array(F.collect_list(kept)).alias("members"), F.max("height").alias("height"))
        levels = F.aggregate(
            F.sequence(F.lit(0), F.lit(BLOCK_LEVELS - 1)), F.array(F.transform("members", lambda m: m["digest"])),
            lambda done, k: F.concat(done, F.array(F.when(
                k + F.lit(base) < F.col("height"), _next_level(F.element_at(done, -1))).otherwise(F.element_at(done, -1)))))
        blocks = members.withColumn("levels", levels)
        if rounds:
            blocks = blocks.drop("members")
        rounds.append(stage(blocks, "blocks"))
        if largest <= BLOCK << base:
            return Forest(rounds)
        current = rounds[-1].select(
            "tree", F.col("block").alias("pos"), F.get(F.get("levels", F.lit(BLOCK_LEVELS)), F.lit(0)).alias("digest"), "height")


def climb(start: Column, path: Column) -> Column:
    """``start`` and the copies of its ancestors, up to the root, from the siblings of its path."""

    def up(done: Column, s: Column) -> Column:
        own, other = F.element_at(done, -1), F.coalesce(s["digest"], F.lit(""))
        return F.concat(done, F.array(sha(F.when(s["on_left"], F.concat(other, own)).otherwise(F.concat(own, other)))))

    return F.aggregate(path, F.array(start), up)


@dataclass
class Manifest:
    """``leaves``: a row per document with its digests, its path of siblings and the nodes of its
    version; ``trees`` and ``top``: the hash trees of the languages and the one over them."""

    leaves: DataFrame
    trees: Forest
    top: Forest


def manifest(docs: DataFrame) -> Manifest:
    """The hash trees of a table, and a version for every tampered row."""
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    # Wide enough for the largest long and one.
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    leaves = stage(docs.select(
        _quote(F.col("lang")).alias("tree"), "doc_id", leaf().alias("digest"),
        F.when(changed, leaf(n_chars=more)).alias("tampered")), "leaves")
    trees = grow(placed(leaves, ("doc_id", "digest")).withColumn("member", F.struct("doc_id", "tampered")))
    subroots = stage(trees.roots, "subroots")
    top = grow(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ("name",))
               .withColumn("member", F.struct("name")))
    root = top.roots.select(F.col("tree").alias("all"), F.col("digest").alias("root"))
    spread = top.paths(top.roots.select("tree", F.array().cast(_STEP).alias("path")))
    above = (
        _with_paths(top, spread, lambda m: F.struct(m["member"]["name"].alias("name"), m["digest"].alias("subroot")))
        .join(root, F.col("tree") == F.col("all"))
        .select(F.col("name").alias("tree"), "path", "subroot", "root"))
    found = _with_paths(trees, trees.paths(stage(above, "above")), lambda m: F.struct(
        m["member"]["doc_id"].alias("doc_id"), m["digest"].alias("leaf"), m["member"]["tampered"].alias("tampered")))
    versions = found.withColumn("version", climb(F.coalesce("tampered", "leaf"), F.col("path")))
    return Manifest(versions, trees, top)


def _with_paths(forest: Forest, paths: DataFrame, fields) -> DataFrame:
    """A row per node of the first round, with ``fields`` of it and its whole ``path``."""
    whole = forest.rounds[0].join(paths, ["tree", "block"])
    rows = F.transform("members", lambda m, i: F.struct(
        fields(m).alias("row"), siblings(F.col("levels"), i, F.col("height"), 0).alias("own")))
    extra = [c for c in paths.columns if c not in ("tree", "block", "path")]
    return whole.select("tree", *extra, "path", F.explode(rows).alias("x")).select(
        "tree", *extra, F.concat("x.own", "path").alias("path"), "x.row.*")


def proof(path: Column) -> Column:
    return sha(F.array_join(F.transform(path, lambda s: F.coalesce(s["digest"], F.lit(""))), ""))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    folded = F.element_at("version", -1)
    return manifest(docs).leaves.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(documents(spark, sf_dir))


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({value} AS VARCHAR))), ':', CAST({value} AS VARCHAR)) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(concat(" + ", ".join(_field_sql(n_chars if name == "n_chars" else name) for name in FIELDS) + "))"


#: Check SQL: levels and folds one by one, and CRC-32 from its table.
ORACLE = f"""
WITH RECURSIVE
steps(i, step, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE step = 8),
checked AS (
  SELECT d.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(
    range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM documents d, crc_table),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN crc % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS changed FROM checked),
placed AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS size FROM leaves),
nodes(tree, level, pos, digest, size) AS (
  SELECT tree, 0, pos, leaf, size FROM placed UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2
  FROM nodes WHERE size > 1 GROUP BY tree, level, pos // 2, size),
ranks AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops(tree, level, pos, digest, size) AS (
  SELECT '', 0, place, digest, size FROM ranks UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (size + 1) // 2
  FROM tops WHERE size > 1 GROUP BY tree, level, pos // 2, size),
every AS (SELECT * FROM nodes UNION ALL SELECT * FROM tops),
fold(rid, tree, level, pos, digest, proof, done) AS (
  SELECT rid, tree, 0, pos, coalesce(changed, leaf), '', false FROM placed UNION ALL
  SELECT f.rid, CASE WHEN o.size > 1 THEN f.tree ELSE '' END, CASE WHEN o.size > 1 THEN f.level + 1 ELSE 0 END,
    CASE WHEN o.size > 1 THEN f.pos // 2 ELSE r.place END,
    CASE WHEN o.size = 1 THEN f.digest WHEN f.pos % 2 = 1 THEN sha256(s.digest || f.digest) ELSE sha256(f.digest || coalesce(s.digest, '')) END,
    CASE WHEN o.size > 1 THEN f.proof || coalesce(s.digest, '') ELSE f.proof END, o.size = 1 AND f.tree = ''
  FROM fold f JOIN every o ON o.tree = f.tree AND o.level = f.level AND o.pos = f.pos
  LEFT JOIN every s ON s.tree = f.tree AND s.level = f.level AND s.pos = CASE WHEN f.pos % 2 = 1 THEN f.pos - 1 ELSE f.pos + 1 END
  LEFT JOIN ranks r ON r.tree = f.tree WHERE NOT f.done)
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM placed p JOIN fold f ON f.rid = p.rid AND f.done JOIN ranks r ON r.tree = p.tree CROSS JOIN (SELECT digest FROM tops WHERE size = 1) t
"""
