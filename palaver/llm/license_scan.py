"""License scan with a positional index of rare words.

Licence words (the words of all templates) get document frequencies over the whole corpus.
Each template is filed under its word of highest inverse document frequency. A file looks up the
licence words it has: only templates filed under one of them can occur in it. For those, the
postings of all template words vote for the template's start, position minus offset; votes for
one start are the intersection by relative position. A start counts if the votes reach the
template's share and every word of its mandatory key phrase voted.

Votes are rows, grouped by (file, template, start), so a file made of licence words alone is as
cheap per word as any other. Only licence words leave the text.

Null and empty texts have no words, no labels and score 0. Repeated rows get equal rows; a null
id stays null. Columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from palaver.llm.common import documents, with_row_id

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``share``: least part of the words that must stand at their relative place; the words of
    ``key`` (a stretch of the text) must all do."""

    label: str
    text: str
    key: str
    base: bool = False
    share: float = 1.0


# The four base phrases with their labels.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)

#: Further notices, with labels of their own.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0", share=0.75),
    Template("mit-notice", "released under the mit license", "mit license", share=0.75),
    Template("gpl-notice", "under the terms of the gnu general public license", "gnu general public license", share=0.75),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0", share=0.75),
    Template("bsd", "bsd license", "bsd license"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("creative-commons", "creative commons attribution", "creative commons attribution"),
)


def _template_words(templates: tuple[Template, ...]) -> list[tuple[int, str, int, bool]]:
    """(template, word, offset, mandatory) of every template word."""
    rows = []
    for t, template in enumerate(templates):
        words, key = template.text.split(), template.key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        rows += [(t, word, i, at <= i < at + len(key)) for i, word in enumerate(words)]
    return rows


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    words = _template_words(templates)
    vocabulary = sorted({word for _, word, _, _ in words})
    split = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), SEPARATORS), lambda w: w != "")
    found = F.filter(
        F.transform(
            F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
                     lambda x: F.lower(x["word"]).isin(vocabulary)),
            lambda x: F.struct(F.translate(x["word"], UPPER, LOWER).alias("word"), x["at"].alias("at"))),
        lambda x: x["word"].isin(vocabulary))
    files = with_row_id(
        docs.select("doc_id", split.alias("words"))
        .select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("postings")), "file")

    # At most one row per vocabulary word reaches the driver.
    counted = files.select(F.explode(F.array_distinct(F.transform("postings", lambda x: x["word"]))).alias("word")).groupBy("word").count()
    frequency = {row["word"]: row["count"] for row in counted.collect()}
    anchors = {}
    for t, word, _, mandatory in words:
        if mandatory:
            rarest = anchors.get(t)
            if rarest is None or (frequency.get(word, 0), word) < (frequency.get(rarest, 0), rarest):
                anchors[t] = word

    index = F.broadcast(spark.createDataFrame(
        [(word, t, offset, mandatory) for t, word, offset, mandatory in words],
        "word string, template int, offset int, mandatory boolean"))  # one row per template word
    facts = F.broadcast(spark.createDataFrame(
        [(t, x.label, x.base, x.share, len(x.text.split()), len(x.key.split()), anchors[t]) for t, x in enumerate(templates)],
        "template int, label string, base boolean, share double, n_text int, n_key int, anchor string"))
    has = F.transform("postings", lambda x: x["word"])
    candidates = (
        files.filter(F.arrays_overlap(has, F.array(*[F.lit(a) for a in sorted(set(anchors.values()))])))
        .select("file", F.explode("postings").alias("p")).select("file", "p.word", "p.at"))
    starts = (
        candidates.join(index, "word")
        .groupBy("file", "template", (F.col("at") - F.col("offset")).alias("start"))
        .agg(F.count("*").alias("votes"), F.count_if("mandatory").alias("key_votes"))
        .join(facts, "template")
        .filter("key_votes = n_key")
        .withColumn("match", F.col("votes") / F.col("n_text"))
        .filter("match >= share"))
    per_file = starts.groupBy("file").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("match").alias("score"))
    return files.join(per_file, "file", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _oracle() -> str:
    parts = []
    for x in BASE + NOTICES:
        parts.append((x.label, x.base, x.share, x.text.split(), x.key.split()))
    values = ", ".join(
        f"('{label}', {str(base).lower()}, {share}, {text!r}, {len(text)}, {next(i for i in range(len(text)) if text[i:i + len(key)] == key)}, {len(key)})"
        for label, base, share, text, key in parts)
    return rf"""
WITH templates(label, base, share, words, n_text, key_at, n_key) AS (VALUES {values}),
files AS (SELECT row_number() OVER () AS file, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
tokens AS (SELECT file, unnest(words) AS word, unnest(range(len(words))) AS pos FROM files),
parts AS (SELECT label, base, share, n_text, key_at, n_key, unnest(words) AS word, unnest(range(n_text)) AS off FROM templates),
votes AS (SELECT file, label, base, share, n_text, n_key, pos - off AS start, count(*) AS votes,
                 count(*) FILTER (WHERE off >= key_at AND off < key_at + n_key) AS key_votes
          FROM tokens JOIN parts USING (word) GROUP BY ALL),
starts AS (SELECT *, votes / n_text AS match FROM votes WHERE key_votes = n_key AND votes / n_text >= share),
per_file AS (SELECT file, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
                    max(start) FILTER (WHERE base) AS last_word,
                    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
                    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(match) AS score FROM starts GROUP BY file)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM files LEFT JOIN per_file USING (file)
"""


ORACLE = _oracle()
