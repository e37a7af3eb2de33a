"""Token counts of documents in flat token files.

A flat file is a run of little-endian 16-bit ids, blocks of it in rows (file, block, data); nothing
says where documents begin. Each block is searched for the end-of-document id in one vectorised
pass, which gives the lengths between its ends and what lies before the first and after the last.
A prefix scan over a file's blocks (ends so far, and the place of the last end so far) then adds
to each block's first document what earlier blocks hold of it, over any number of blocks.

``write_flat`` makes such files from documents, with their ids in order beside them. Null and empty
texts have 0 tokens; the end id is never made from text. Repeated rows get equal rows; a null id
stays null. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palaver.llm.byte_tokens import byte_tokens
from palaver.llm.common import documents, map_batches, release_memory, stage

#: Ids in a block.
BLOCK = 1 << 18
END_ID = 50256


def write_flat(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks: file, block, data), (order: file, ordinal, doc_id); a file per input split."""

    def run(batches):
        tokens, file = byte_tokens(False), TaskContext.get().partitionId()
        end, rest, n_blocks, ordinal = np.array([END_ID], "<u2"), np.empty(0, "<u2"), 0, 0
        empty = pa.array([None], pa.int64())

        def rows(blocks: list[bytes], ids: pa.Array, first: int):
            n, m = len(blocks), len(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * (n + m), pa.int32()),
                pa.array([*range(n_blocks - n, n_blocks), *range(first, first + m)], pa.int64()),
                pa.array(blocks + [None] * m, pa.binary()),
                pa.concat_arrays([pa.nulls(n, pa.int64()), ids])], names=["file", "number", "data", "doc_id"])

        for batch in batches:
            parts = [rest]
            for text in batch.column("text"):
                parts += [np.frombuffer(tokens.encode(text.as_py() or ""), "<u4").astype("<u2"), end]
            flat = np.concatenate(parts)
            whole = len(flat) // block
            blocks = [flat[i * block:(i + 1) * block].tobytes() for i in range(whole)]
            rest, n_blocks = flat[whole * block:], n_blocks + whole
            yield rows(blocks, batch.column("doc_id"), ordinal)
            ordinal += batch.num_rows
        if len(rest):
            n_blocks += 1
            yield rows([rest.tobytes()], empty[:0], ordinal)
        release_memory()

    both = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(
        run, "file int, number long, data binary, doc_id long")
    with_codec = stage(both, "flat")
    return (with_codec.filter("data IS NOT NULL").selectExpr("file", "number AS block", "data"),
            with_codec.filter("data IS NULL").selectExpr("file", "number AS ordinal", "doc_id"))


def count_tokens(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """file, ordinal, n_tokens of every document; what follows a file's last end is a document
    if it has tokens."""

    def run(batch: pa.RecordBatch):
        size, ends, first, last, lengths = [], [], [], [], []
        for data in batch.column("data"):
            ids = np.frombuffer(data.as_buffer(), "<u2")
            at = np.flatnonzero(ids == end_id)
            size.append(len(ids)), ends.append(len(at))
            first.append(int(at[0]) if len(at) else None), last.append(int(at[-1]) if len(at) else None)
            lengths.append((np.diff(at) - 1).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("block"), pa.array(size, pa.int64()), pa.array(ends, pa.int64()),
             pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))],
            names=["file", "block", "size", "ends", "first", "last", "lengths"])

    searched = map_batches(blocks.select("file", "block", "data"), run,
                           "file int, block long, size long, ends long, first long, last long, lengths array<long>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block")
    scanned = (
        searched.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .withColumn("docs_before", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
        .withColumn("last_end", F.coalesce(F.max(F.col("before") + F.col("last")).over(earlier), F.lit(-1)))
        .withColumn("final", F.lead("block").over(upto).isNull())
        .withColumn("carried", F.col("before") - F.col("last_end") - 1)
        .withColumn("tail", F.when(F.col("ends") > 0, F.col("size") - F.col("last") - 1).otherwise(F.col("carried") + F.col("size"))))
    counts = F.concat(
        F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("first")), "lengths")).otherwise(F.array().cast("array<long>")),
        F.when(F.col("final") & (F.col("tail") > 0), F.array("tail")).otherwise(F.array().cast("array<long>")))
    return scanned.select("file", "docs_before", F.posexplode(counts).alias("at", "n_tokens")).select(
        "file", (F.col("docs_before") + F.col("at")).alias("ordinal"), "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, order = write_flat(documents(spark, sf_dir))
    return order.join(count_tokens(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens")
