"""The corpus pipeline: documents that pass the quality rules, one of each near-duplicate group,
without repeated strings, packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palaver.llm.common import documents, stage
from palaver.llm.ngram_join import one_of_each
from palaver.llm.packing import packed
from palaver.llm.quality_rules import keep_quality
from palaver.llm.suffix_dedup import without_repeats

#: Each takes (spark, docs, sf_dir); all but the last return the columns of their docs.
STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_join", one_of_each),
    ("suffix_dedup", without_repeats),
    ("best_fit_packing", packed),
]

#: SQL has neither the tokenizer nor the byte strings; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
