"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document. The ledger keeps the measurements and one integer
whose bit i is set where rule i fails. Policies, named and versioned, are masks over these bits:
a document is kept by a policy if ``failed_bits & mask = 0``. Ablations need no second look at a
text: documents that a policy would regain without rule i are those with
``failed_bits & mask = bit i``, counted over the histogram of distinct ledger values, which has at
most 2 ** rules rows.

DataFrame functions only. Null and empty texts have no words and fail the length rule. Repeated
rows get equal rows; a null id stays null. Columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palaver.llm.common import documents, words_of

WORD_CHAR_GAP = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """Fails where ``condition``, SQL over the measurements, is true."""

    name: str
    condition: str


#: Bit i belongs to rule i; new rules are only ever appended.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "n_symbols > n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
)

#: (name, version) -> names of the rules that decide.
POLICIES = {
    ("base", 1): ("too_few_words", "repeated_windows"),
    ("standard", 1): tuple(rule.name for rule in RULES),
}


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    order = [rule.name for rule in rules]
    return sum(1 << order.index(name) for name in names)


def repeated_words(words: str) -> tuple[Column, Column]:
    """Two columns to add in turn: the repeated 3-word windows of an array column, and the number
    of words inside them. Windows are ordered by a 96-bit hash and position, so that equal ones
    are neighbours; this is n log n for a text of any length."""
    w = F.col(words)
    windows = F.sort_array(F.transform(
        F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("a"),
            F.hash(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("b"),
            i.alias("at"),
        )))
    s = F.col("windows")
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))
    starts = F.sort_array(F.transform(
        F.filter(
            F.transform(s, lambda x, i: F.struct(
                x["at"].alias("at"),
                (same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1))).alias("twice"))),
            lambda x: x["twice"]),
        lambda x: x["at"]))
    return windows, starts


def measure(docs: DataFrame) -> DataFrame:
    """The measurements of every document: doc_id and one column each."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(HAS_WORD))
    windows, starts = repeated_words("words")
    p = F.col("starts")
    return (
        docs.select("doc_id", text.alias("text"))
        .select(
            "doc_id", words_of(F.col("text")).alias("words"), lines.alias("lines"),
            F.length(F.regexp_replace("text", WORD_CHAR_GAP, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("text", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"))
        .select(
            "doc_id", "word_chars", "n_symbols",
            F.size("words").cast("long").alias("n_words"), windows.alias("windows"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
        .withColumn("starts", starts)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines",
            F.aggregate(
                F.transform(p, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - at, F.lit(3)))),
                F.lit(0).cast("long"), lambda total, x: total + x).alias("n_repeat_words"))
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed_bits`` of every document."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, policy: tuple[str, int] = ("standard", 1), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``kept``, the verdict of one policy."""
    return entries.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy], rules))) == 0)


def ablations(entries: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per policy and rule in it: documents that fail it, and those only it rejects."""
    rows = [(name, version, rule, mask_of(chosen, rules), mask_of((rule,), rules))
            for (name, version), chosen in POLICIES.items() for rule in chosen]
    table = F.array(*[F.struct(
        F.lit(n).alias("policy"), F.lit(v).alias("version"), F.lit(r).alias("rule"),
        F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for n, v, r, m, b in rows])
    histogram = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    return (
        histogram.select("failed_bits", "n", F.explode(table).alias("t")).select("failed_bits", "n", "t.*")
        .groupBy("policy", "version", "rule")
        .agg(
            F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
            F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("mask")) == F.col("bit"), F.col("n")).otherwise(0)).alias("n_regained"))
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    entries = apply_policy(ledger(docs))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask_of(POLICIES[("base", 1)]))) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "n_lines", "failed_bits")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the standard policy rejects go. The rows themselves pass
    through one projection, so no join by id is needed and repeated rows stay repeated."""
    columns = list(docs.columns)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc_id"), "text")
    # The row's number keeps the filter above the projection: pushed down, it would copy every rule's expressions into itself.
    kept = apply_policy(ledger(whole)).withColumn("row_number", F.monotonically_increasing_id()).filter("kept AND row_number >= 0")
    return kept.select("doc_id.*").select(*[F.col(f"`{c}`") for c in columns])


MEASURES_SQL = r"""
SELECT doc_id, rid, txt, len(words) AS n_words, words,
       length(regexp_replace(txt, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
       length(regexp_replace(txt, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
       len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines
FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS txt,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM {table})
"""

LEDGER_SQL = """
measured AS (""" + MEASURES_SQL + """),
tri AS (SELECT rid, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] AS tri
        FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM measured)),
twice AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, tri) > 1),
covered AS (SELECT rid, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n_repeat_words
            FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
entries AS (SELECT m.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words FROM measured m LEFT JOIN covered c USING (rid)),
ledger AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END AS failed_bits FROM entries)
"""

ORACLE = "WITH " + LEDGER_SQL.replace("{table}", "documents") + """
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(failed_bits AS BIGINT) AS failed_bits FROM ledger
"""
