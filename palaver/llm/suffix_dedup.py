"""Substring dedup by external induced sorting of suffixes.

Two strings of 200 bytes are equal if their suffixes share a prefix of 200 bytes, so what is wanted
are the neighbours in suffix order whose common prefix is that long. As in induced sorting, only
sample suffixes are sorted; the order of all others, and their common prefixes, are induced from
them, one byte further left at a time.

* The sample: of each 200-byte string, the place of its smallest 32-byte gram by hash, the leftmost
  if several. Equal strings have it at the same place, so strings with different grams never need
  comparing, and grams are the keys of the shards.
* Only grams that occur twice or more are followed (a fixed-size bitmap: more bits than needed cost
  time, not bytes). Each of their places sends one suffix tuple: gram, the bytes to the right of it,
  and the bytes to the left that induction will need. Equal tuples are merged first, so copies by
  the thousand are one tuple with a count.
* Spark sorts the tuples of a shard by gram and right-hand bytes, on disk where memory is short, and
  a task takes them off in order, a bounded number at a time: this is the queue. The first common
  prefixes come from neighbours. One step of induction moves every suffix one byte to the left:
  a stable sort by that byte keeps the order, and a common prefix is one more than the least
  between two that stay neighbours, or nothing where the byte differs.
* Grams with more than ``HOT`` distinct tuples are not gathered in a task: all their strings
  are hashed and counted by one aggregate instead.

One level of sampling is enough, because nothing past 200 bytes is compared; names for a recursion on
the sample would only be longer strings than that.

Strings are judged on the input, in the same document too, and never cross documents. Null and empty
texts have no bytes. Texts under 200 bytes lose nothing. Repeated rows are copies of one another like
any other; equal rows get equal results. A null id stays null. Columns other than id and text are
not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from palaver.llm import common, hashing
from palaver.llm.common import documents, input_splits, release_memory, stage
from palaver.llm.graph import bitmap

LENGTH = 200
GRAM = 32
#: Distinct tuples of a gram that one task may gather; tuples that are induced together.
HOT, TOGETHER = 50_000, 8_000
_PLACE = 30  # bits of a place in its run of texts

#: Its batches need much memory, which the stages after it want back.
map_batches = partial(common.map_batches, release=True)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram at each place, prefix sums of the bytes)."""
    sums = hashing.prefix_sums(hashing._SYMBOLS[data])
    _, down = hashing.powers(len(data))
    n = len(data) - gram + 1
    return hashing.mix((sums[gram:] - sums[:n]) * down[:n]) if n > 0 else np.empty(0, np.uint64), sums


def sampled(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of neighbouring strings with one sample place: (gram hash, place, first string, last
    string, text), and the prefix sums. Strings lie inside one text each."""
    hashes, sums = gram_hashes(data, gram)
    n = len(data) - length + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return np.empty(0, np.uint64), empty, empty, empty, empty, sums
    place = np.arange(len(hashes), dtype=np.uint64)
    low = (hashes & ~np.uint64((1 << _PLACE) - 1)) | place
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    low = np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
    at = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n), side="right") - 1
    inside = np.arange(n) + length <= offsets[text + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return np.empty(0, np.uint64), empty, empty, empty, empty, sums
    at, text = at[starts], text[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return hashes[at[first]], at[first], starts[first], starts[last], text[first], sums


def tuple_keys(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each tuple's bytes and of where the sample place is in them."""
    _, down = hashing.powers(len(sums) - 1)
    return hashing.mix(hashing.mix((sums[end] - sums[begin]) * down[begin]) + (place - begin).astype(np.uint64) * np.uint64(1 << 20) + (end - begin).astype(np.uint64))


def row_keys(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A key of each row: its id and its text."""
    text = hashing.mix(hashing.digests(data, offsets[:-1], offsets[1:]))
    return hashing.mix(text + hashing.mix(np.where(known, ids, -7).astype(np.int64).view(np.uint64) + known.astype(np.uint64)))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("doc_id")
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def sample_grams(docs: DataFrame, length: int) -> DataFrame:
    """(gram, places): the sample places of all strings."""

    def run(batch: pa.RecordBatch):
        for _, data, offsets in hashing.chunks(batch.column("text")):
            grams, *_ = sampled(data, offsets, length)
            grams, places = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(places.astype(np.int64))], names=["gram", "places"])

    return map_batches(docs, run, "gram long, places long")


def suffix_tuples(docs: DataFrame, shared, length: int) -> DataFrame:
    """(gram, tuple, n, reach, left, right): merged in a chunk of texts. ``left`` ends before the sample
    place and is as long as the farthest string needs; ``reach`` is how many strings there are."""

    def run(batch: pa.RecordBatch):
        for _, data, offsets in hashing.chunks(batch.column("text")):
            grams, place, first, last, _, sums = sampled(data, offsets, length)
            if not len(grams):
                continue
            hit = np.flatnonzero(hashing.set_bit(shared.value, grams))
            grams, place, first, last = grams[hit], place[hit], first[hit], last[hit]
            keys = tuple_keys(sums, first, last + length, place)
            _, one, n = np.unique(keys, return_index=True, return_counts=True)
            raw = data.tobytes()
            left = [raw[a:b] for a, b in zip(first[one].tolist(), place[one].tolist())]
            right = [raw[a:b] for a, b in zip(place[one].tolist(), (last[one] + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[one].view(np.int64)), pa.array(keys[one].view(np.int64)), pa.array(n.astype(np.int64)),
                 pa.array((last - first + 1)[one].astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["gram", "tuple", "n", "reach", "left", "right"])

    return map_batches(docs, run, "gram long, tuple long, n long, reach int, left binary, right binary")


def induce(gram: np.ndarray, left: list[bytes], right: list[bytes], reach: np.ndarray, length: int) -> list[np.ndarray]:
    """For tuples in order of (gram, right): of each, which of its strings, first to last, have an
    equal in another tuple."""
    m = len(gram)
    n_left = np.array([len(x) for x in left])
    n_right = np.array([len(x) for x in right])
    found = np.zeros(int(reach.sum()), bool)
    base = np.concatenate([[0], np.cumsum(reach)])[:-1]
    left_end = np.cumsum(n_left)
    left_bytes = np.frombuffer(b"".join(left), np.uint8)
    right_bytes, right_at = np.frombuffer(b"".join(right), np.uint8), np.cumsum(n_right) - n_right
    group = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])]).astype(np.int64)
    prefix = np.zeros(m, np.int32)
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    for k in range(length):
        same = same[(n_right[same] > k) & (n_right[same - 1] > k)]
        same = same[right_bytes[right_at[same] + k] == right_bytes[right_at[same - 1] + k]]
        if not len(same):
            break
        prefix[same] = k + 1
    index = np.arange(m)
    step = 0
    while len(index):
        twin = prefix >= length
        if twin.any():
            twin[:-1] |= twin[1:].copy()
            each = index[twin]
            # The string that starts ``step`` bytes left of the sample place is n_left - step from the first.
            found[base[each] + n_left[each] - step] = True
        step += 1
        keep = np.flatnonzero(n_left[index] >= step)
        if not len(keep):
            break
        prefix = np.minimum.reduceat(prefix[:keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
        index = index[keep]
        key = group[index] * 256 + left_bytes[left_end[index] - step]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        stay = np.flatnonzero(sorted_key[1:] == sorted_key[:-1]) + 1
        new = np.zeros(len(index), np.int32)
        low, high = order[stay - 1], order[stay]
        least = prefix[high].copy()
        far = np.flatnonzero(high - low > 1)
        back = 1
        while len(far):
            least[far] = np.minimum(least[far], prefix[high[far] - back])
            back += 1
            far = far[(high[far] - low[far] > back) & (least[far] > 0)]
        new[stay] = np.minimum(least + 1, length)
        index, prefix = index[order], new
        lonely = (new == 0) & np.append(new[1:] == 0, True)  # has nothing in common with a neighbour any more
        if lonely.any():
            index, prefix = index[~lonely], prefix[~lonely]
    return np.split(found, base[1:])


def twin_flags(tuples: DataFrame, length: int) -> DataFrame:
    """(tuple, flags): the strings of each tuple that have an equal in another tuple of its gram."""

    def run(batches):
        held: list[tuple] = []

        def done(rows: list[tuple]):
            flags = induce(np.array([r[0] for r in rows]), [r[3] for r in rows], [r[4] for r in rows], np.array([r[2] for r in rows]), length)
            some = [i for i, f in enumerate(flags) if f.any()]
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][1] for i in some], pa.int64()), pa.array([np.packbits(flags[i]).tobytes() for i in some], pa.binary())], names=["tuple", "flags"])

        for batch in batches:
            held += zip(*[batch.column(c).to_pylist() for c in ("gram", "tuple", "reach", "left", "right")])
            if len(held) >= TOGETHER:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:  # the last gram may go on in the next batch
                    cut -= 1
                if cut:
                    yield done(held[:cut])
                    held = held[cut:]
        if held:
            yield done(held)
        release_memory()

    shards = input_splits(tuples)
    ordered = tuples.select("gram", "tuple", "reach", "left", "right").repartition(shards, "gram").sortWithinPartitions("gram", "right")
    return ordered.mapInArrow(run, "tuple long, flags binary")


def counted_flags(tuples: DataFrame, length: int) -> DataFrame:
    """The same for grams with too many tuples: every string is hashed and counted."""

    def strings(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column("left")[i].as_py() + batch.column("right")[i].as_py(), np.uint8)
            n = len(data) - length + 1
            sums = hashing.prefix_sums(hashing._SYMBOLS[data])
            _, down = hashing.powers(len(data))
            hashes = hashing.mix((sums[length:] - sums[:n]) * down[:n])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(np.full(n, batch.column("tuple")[i].as_py())), pa.array(np.arange(n, dtype=np.int32))],
                names=["string", "tuple", "at"])

    rows = map_batches(tuples.select("tuple", "left", "right"), strings, "string long, tuple long, at int")
    twice = rows.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1")
    places = rows.join(twice.select("string"), "string").groupBy("tuple").agg(F.collect_set("at").alias("at"))

    def packed(batch: pa.RecordBatch):
        flags = []
        for at in batch.column("at"):
            marks = np.zeros(length, bool)
            marks[at.values.to_numpy(zero_copy_only=False)] = True
            flags.append(np.packbits(marks).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("tuple"), pa.array(flags, pa.binary())], names=["tuple", "flags"])

    return map_batches(places, packed, "tuple long, flags binary")


def places_of(docs: DataFrame, shared, length: int) -> DataFrame:
    """(tuple, row_key, first, reach, times) of every sample place with a shared gram; neighbours of
    one tuple, as in a run of one byte, are one row."""

    def run(batch: pa.RecordBatch):
        ids, known = _ids(batch)
        for row0, data, offsets in hashing.chunks(batch.column("text")):
            grams, place, first, last, text, sums = sampled(data, offsets, length)
            if not len(grams):
                continue
            hit = np.flatnonzero(hashing.set_bit(shared.value, grams))
            place, first, last, text = place[hit], first[hit], last[hit], text[hit]
            keys = tuple_keys(sums, first, last + length, place)
            row = row_keys(data, offsets, ids[row0:row0 + len(offsets) - 1], known[row0:row0 + len(offsets) - 1])
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]) | (first[1:] != first[:-1] + 1) | (last[1:] != first[1:])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at].view(np.int64)), pa.array(row[text[at]].view(np.int64)), pa.array(first[at] - offsets[text[at]]),
                 pa.array((last - first + 1)[at].astype(np.int32)), pa.array(times.astype(np.int32))],
                names=["tuple", "row_key", "first", "reach", "times"])

    return map_batches(docs, run, "tuple long, row_key long, first long, reach int, times int")


def removed_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(row_key, spans): for every row that loses bytes, runs of strings that occur elsewhere as
    (first, reach, times, flags); without flags all do."""
    spark = docs.sparkSession
    repeated = sample_grams(docs, length).groupBy("gram").agg(F.sum("places").alias("places")).filter("places > 1")
    shared = spark.sparkContext.broadcast(bitmap(repeated, "gram"))
    merged = (suffix_tuples(docs, shared, length).groupBy("gram", "tuple")
              .agg(F.sum("n").alias("n"), F.first("reach").alias("reach"), F.first("left").alias("left"), F.first("right").alias("right")))
    tuples = stage(merged, "tuples")
    sizes = tuples.groupBy("gram").agg(F.count("*").alias("tuples"))
    crowd = stage(sizes.filter(F.col("tuples") > hot).select("gram"), "crowd")
    several = tuples.join(sizes.filter((F.col("tuples") > 1) & (F.col("tuples") <= hot)).select("gram"), "gram", "left_semi")
    flags = twin_flags(several, length)
    if not crowd.isEmpty():
        flags = flags.union(counted_flags(tuples.join(crowd, "gram", "left_semi"), length))
    copied = tuples.filter("n > 1").select("tuple", F.lit(None).cast("binary").alias("flags"))
    lost = stage(copied.union(flags.join(copied.select("tuple"), "tuple", "left_anti")), "flags")
    found = places_of(docs, shared, length).join(lost, "tuple")
    spans = stage(found.groupBy("row_key").agg(F.collect_list(F.struct("first", "reach", "times", "flags")).alias("spans")), "spans")
    shared.destroy()  # else every executor keeps it on its disk
    return spans


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. With ``carry``, those columns
    of the rows and ``kept``, the bytes that are left, follow."""
    rest = [c for c in carry]
    docs = docs.select(F.expr("cast(doc_id AS bigint)").alias("doc_id"), "text",
                       *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("carried")] if rest else []))
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "text")
    spans = removed_spans(narrow, length, hot)
    touched = spark.sparkContext.broadcast(bitmap(spans, "row_key"))

    def keyed(batches):
        """Adds the row's key, and whether it may lose bytes."""
        for batch in batches:
            ids, known = _ids(batch)
            keys = np.zeros(batch.num_rows, np.uint64)
            for row0, data, offsets in hashing.chunks(batch.column("text")):
                keys[row0:row0 + len(offsets) - 1] = row_keys(data, offsets, ids[row0:row0 + len(offsets) - 1], known[row0:row0 + len(offsets) - 1])
            yield batch.append_column("row_key", pa.array(keys.view(np.int64))).append_column("touched", pa.array(hashing.set_bit(touched.value, keys)))
        release_memory()

    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def result(batch: pa.RecordBatch):
        spans_of = batch.column("spans") if "spans" in batch.schema.names else None
        out: dict[str, list] = {c: [] for c in columns[1:] + ["kept"]}
        for i, text in enumerate(batch.column("text")):
            raw = (text.as_py() or "").encode()
            data = np.frombuffer(raw, np.uint8)
            cover = np.zeros(len(data) + 1, np.int32)
            for span in (spans_of[i].as_py() or []) if spans_of is not None else []:
                n = span["reach"]
                offsets = np.arange(n) if span["flags"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(span["flags"], np.uint8))[:n])
                starts = (span["first"] + np.arange(span["times"])[:, None] + offsets[None, :]).ravel()
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = data[~gone].tobytes() if len(data) else b""
            out["n_bytes"].append(len(data))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if rest:
                out["kept"].append(kept)
        arrays = [batch.column("doc_id"), *[pa.array(out[c], pa.int64()) for c in columns[1:4]], pa.array(out["kept_sha256"], pa.string())]
        names = list(columns)
        if rest:
            arrays, names = arrays + [batch.column("carried"), pa.array(out["kept"], pa.binary())], names + ["carried", "kept"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    types = dict(docs.dtypes)
    more = f", carried {types['carried']}" if rest else ""
    rows = docs.mapInArrow(keyed, f"doc_id long, text string{more}, row_key long, touched boolean")
    schema = SCHEMA + (more + ", kept binary" if rest else "")
    whole = map_batches(rows.filter("NOT touched").drop("row_key", "touched"), result, schema)
    cut = map_batches(rows.filter("touched").drop("touched").join(spans, "row_key", "left").drop("row_key"), result, schema)
    both = whole.unionByName(cut)
    return both.select(*columns, *([F.col("carried.*"), "kept"] if rest else []))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated strings go from every text. A text of which a removal leaves part of a
    character has that part replaced; n_chars, where there is such a column, follows the new text."""
    columns = list(docs.columns)
    others = [c for c in columns if c not in ("doc_id", "text")]
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"other_{i}") for i, c in enumerate(others)], F.col("text").isNull().alias("no_text"))
    kept = dedup(renamed, carry=tuple([f"other_{i}" for i in range(len(others))] + ["no_text"]))
    text = F.when(F.col("no_text"), F.lit(None)).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    out = kept.withColumn("new_text", text)
    final = {"doc_id": F.col("doc_id"), "text": F.col("new_text")}
    for i, c in enumerate(others):
        final[c] = F.length("new_text").cast(dict(docs.dtypes)[c]) if c == "n_chars" else F.col(f"other_{i}")
    return out.select(*[final[c].alias(c) for c in columns])
