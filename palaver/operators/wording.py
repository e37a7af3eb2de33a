"""Word statistics of many texts, without ever sending a text or a word's every occurrence through a shuffle.

Texts stay in the tasks that read them, and are cut into words once for all that is asked of them. A survey
says which words are common: a bounded table of those goes to all tasks. Of an author's texts only distinct
words travel, common ones as small numbers; of a text whose words need values, only the numbers of the words
that the bounded table does not settle. Which words are taken for common changes what is sent, never a result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from palaver.session import stage

#: Texts that are Python strings at a time, and counted facts that a task keeps before it sends them on.
_TEXTS, _FACTS = 64, 500_000
#: Bytes of text that are cut into words at a time: tables of their words fit a processor's cache.
_CUT = 4 << 20
#: Words that all tasks get to know at most, texts in which a task looks for them, and words that it names.
_COMMON, _SURVEYED, _NAMED = 1 << 20, 4_000, 1 << 18
#: Row numbers of a partition begin at a multiple of this (monotonically_increasing_id).
_ROWS_OF_PARTITION = 1 << 33
#: Words of a run that travel as one row.
_WORDS_OF_ROW = 10_000


def gathered(batches: Iterator[pa.RecordBatch], columns: list[str], sized: list[str]) -> Iterator[pa.Table]:
    """The rows in tables of about CUT bytes in the ``sized`` columns: small batches together, large ones in parts."""
    held, size = [], 0
    for batch in batches:
        b = batch.select(columns)
        ends = np.cumsum(np.sum([pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False) for c in sized], axis=0) + 16)
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + _CUT - size, "right")))
            held.append(b.slice(start, end - start))
            size += int(ends[min(end, b.num_rows) - 1]) - before
            start = end
            if size >= _CUT or start < b.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, and of every occurrence the number of its word and of its text, in order.
    Words are those of Python's ``split()``."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    words, word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    empty = pc.index(words, "").as_py()  # what stands before a leading and after a trailing space
    if empty >= 0:
        real = word != empty
        words, row = pa.concat_arrays([words[:empty], words[empty + 1:]]), row[real]
        word = word[real] - (word[real] > empty)
    return words, word, row


def _once(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _joined(group: np.ndarray, texts: pa.Array, groups: int) -> pa.Array:
    """The texts of each group, one a line. ``group`` ascends."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=groups))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), "\n")


@dataclass
class Survey:
    """``sizes`` (author_id, size), bytes of text per author, and ``words`` (word, uses), a guess at the common ones."""

    sizes: DataFrame
    words: DataFrame


def survey(texts: DataFrame, text: str = "content") -> Survey:
    """One pass over (author_id, text): all sizes, and the words that the first texts of each task repeat. Only
    those texts leave the scan."""
    kind = texts.schema["author_id"].dataType.simpleString()

    def added(parts: list[pa.Table], key: str) -> pa.Table:
        sums = pa.concat_tables(parts).group_by(key).aggregate([("n", "sum")])
        return pa.table([sums[key], sums["n_sum"]], names=[key, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, sizes, held, words = None, [], 0, []

        def sent() -> list[pa.RecordBatch]:
            sums = added(sizes, "author_id")
            return pa.table([sums["author_id"], sums["n"], pa.nulls(len(sums), pa.string())], names=["author_id", "size", "word"]).to_batches()

        for b in batches:
            arrow = b.schema.field("author_id").type
            sizes.append(pa.table([b.column("author_id"), b.column("size")], names=["author_id", "n"]))
            held += b.num_rows
            if held >= _FACTS:
                yield from sent()
                sizes, held = [], 0
            read = b.select(["text"]).filter(pc.is_valid(b.column("text")))
            for table in gathered(iter([read]), ["text"], ["text"]) if read.num_rows else ():
                found, word, _ = _cut(_column(table, "text"))
                words.append(pa.table([found, pa.array(np.bincount(word, minlength=len(found)), pa.int64())], names=["word", "n"]))
        if held:
            yield from sent()
        if words:
            counted = added(words, "word").filter(pc.field("n") > 1)
            most = counted.sort_by([("n", "descending"), ("word", "ascending")]).slice(0, _NAMED)
            yield from pa.table([pa.nulls(len(most), arrow), most["n"], most["word"]], names=["author_id", "size", "word"]).to_batches()

    first = F.pmod(F.monotonically_increasing_id(), F.lit(_ROWS_OF_PARTITION)) < _SURVEYED
    seen = texts.select("author_id", F.octet_length(text).cast("long").alias("size"), F.when(first, F.col(text)).alias("text"))
    found = stage(seen.mapInArrow(run, f"author_id {kind}, size long, word string"), "survey")
    sizes = found.where("word is null").groupBy("author_id").agg(F.sum("size").alias("size"))
    words = found.where("word is not null").groupBy("word").agg(F.sum("size").alias("uses"))
    return Survey(stage(sizes, "text-sizes"), words)


def _common(words: DataFrame) -> DataFrame:
    return words.orderBy(F.desc("uses"), "word").limit(_COMMON)


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts or bytes, one after the other, and where each begins and ends."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data else np.empty(0, np.uint8)), bounds - bounds[0]


def _bytes(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The data in pieces of these many bytes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(group: np.ndarray, codes: np.ndarray, groups: int) -> pa.Array:
    """The codes of each group as bytes: steps from one to the next, 7 bits a byte. Groups and in them codes ascend."""
    step = np.diff(codes, prepend=0).astype(np.int32)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    step[first] = codes[first]
    size = (step >= 1 << 7).astype(np.int8) + (step >= 1 << 14) + np.int8(1)
    ends = np.cumsum(size, dtype=np.int64)
    begins = ends - size
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    out[begins] = step & 127 | (size > 1) * 128
    for k in (1, 2):
        more = np.flatnonzero(size > k)
        out[begins[more] + k] = step[more] >> 7 * k & 127 | (size[more] > k + 1) * 128
    return _bytes(out, np.bincount(group, size, groups))


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All codes, and where those of each row begin and end."""
    data, bounds = _raw(packed)
    ends = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    step = (data[begins] & 127).astype(np.int64)
    for k in (1, 2):
        more = np.flatnonzero(ends - begins >= k)
        step[more] |= (data[begins[more] + k] & 127).astype(np.int64) << 7 * k
    bounds = np.searchsorted(begins, bounds)
    sums = np.concatenate([[0], np.cumsum(step)])
    return sums[1:] - np.repeat(sums[bounds[:-1]], np.diff(bounds)), bounds


_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _places(words: pa.Array, bits: int) -> np.ndarray:
    """A number of so many bits for every word, from its length, its first and its last eight bytes."""
    data, bounds = _raw(words)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = np.diff(bounds)
    part = np.minimum(size, 8)
    low = _LOW[part]
    mixed = (eights[bounds[:-1]] & low) * _ODD[0] + ((eights[bounds[1:] - part] & low) + size.astype(np.uint64)) * _ODD[1]
    mixed = (mixed ^ mixed >> np.uint64(32)) * _ODD[2]
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Known:
    """The common words, most common first, of which a word's place is its code, and their values, where they have
    one. ``code_at`` finds them: of words that would share a place the most common has it, the others count as not common."""

    words: pa.Array
    has: np.ndarray
    value: np.ndarray
    code_at: np.ndarray

    @staticmethod
    def of(words: pa.Array, has: np.ndarray, value: np.ndarray) -> Known:
        code_at = np.full(1 << max(8, (8 * len(words) - 1).bit_length()), -1, np.int32)
        places = _places(words, len(code_at).bit_length() - 1)
        code_at[places[::-1]] = np.arange(len(words), dtype=np.int32)[::-1]
        return Known(words, has, value, code_at)

    def codes(self, words: pa.Array) -> np.ndarray:
        """The codes of some words, -1 where one is not common."""
        code = self.code_at[_places(words, len(self.code_at).bit_length() - 1)].astype(np.int64)
        maybe = np.flatnonzero(code >= 0)
        same = pc.equal(self.words.take(pa.array(code[maybe])), words.take(pa.array(maybe))).to_numpy(zero_copy_only=False)
        code[maybe[~same.astype(bool)]] = -1
        return code


#: What ``_read`` says of authors, of comments, and of words that are not common.
_OF_AUTHORS = {"n_words": "long", "n_links": "long", "codes": "binary", "rest": "string", "marks": "string"}
_OF_COMMENTS = {"run": "long", "total": "double", "hits": "long", "open": "binary"}
_OF_WORDS = {"first": "int", "words": "string"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}


def _author_rows(table: pa.Table, cut: tuple, code: np.ndarray, common: int) -> dict[str, pa.Array]:
    """Of every author of some texts: words, comments with a link, distinct words, common ones as their
    codes, and marks of distinct texts."""
    words, word, row = cut
    authors = _column(table, "author_id").dictionary_encode()
    of, n = authors.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(authors.dictionary)
    strange = code < 0
    number = code.copy()
    number[strange] = common + np.arange(strange.sum())
    facts = _once(of[row] << 32 | number[word])
    group, numbers = facts >> 32, facts & 0xFFFFFFFF
    known = numbers < common
    rest = words.filter(pa.array(strange)).take(pa.array(numbers[~known] - common))
    marks = _column(table, "mark").dictionary_encode()
    texts = _once(of << 32 | marks.indices.to_numpy(zero_copy_only=False))
    # No letter but those of http in either case becomes one of them, so a link shows in a word as it is.
    link = pc.match_substring(words, "http", ignore_case=True).to_numpy(zero_copy_only=False)
    linked = np.unique(row[link[word]]) if link.any() else row[:0]
    return {
        "author_id": authors.dictionary,
        "n_words": pa.array(np.bincount(of[row], minlength=n)),
        "n_links": pa.array(np.bincount(of[linked], minlength=n)),
        "codes": _packed(group[known], numbers[known], n),
        "rest": _joined(group[~known], rest, n),
        "marks": _joined(texts >> 32, marks.dictionary.take(pa.array(texts & 0xFFFFFFFF)), n),
    }


def _comment_rows(table: pa.Table, cut: tuple, code: np.ndarray, known: Known, run: int) -> tuple[dict[str, pa.Array], dict[str, pa.Array]]:
    """Of every text the sum and number of the values of its common words, and the numbers of those that are
    not common, as often as they occur; and the words with these numbers."""
    words, word, row = cut
    n, strange = len(table), code < 0
    has, value, number = np.zeros(len(code)), np.zeros(len(code)), np.cumsum(strange, dtype=np.int32) - 1
    has[~strange], value[~strange] = known.has[code[~strange]], known.value[code[~strange]]
    total, hits = (np.bincount(row, of[word], n).astype(float) for of in (value, has))
    left = np.flatnonzero(strange[word])
    n_left = np.bincount(row[left], minlength=n)
    said = pa.array((hits > 0) | (n_left > 0))
    comments = {name: column.filter(said) for name, column in {
        "author_id": _column(table, "author_id"), "comment_id": _column(table, "comment_id"), "run": pa.array(np.full(n, run)),
        "total": pa.array(total), "hits": pa.array(hits.astype(np.int64)), "open": _bytes(number[word[left]].view(np.uint8), 4 * n_left)}.items()}
    strangers = words.filter(pa.array(strange))
    first = np.arange(0, len(strangers), _WORDS_OF_ROW, dtype=np.int32)
    rows = pa.ListArray.from_arrays(pa.array(np.append(first, np.int32(len(strangers)))), strangers)
    return comments, {"run": pa.array(np.full(len(first), run)), "first": pa.array(first), "words": pc.binary_join(rows, "\n")}


def _read(batches: Iterator[pa.RecordBatch], known: Known, of_authors: bool, of_comments: bool) -> Iterator[pa.RecordBatch]:
    """Rows about the authors, the comments and the words that are not common, told apart by what they leave null."""
    run = TaskContext.get().partitionId() << 32
    ids = ["author_id", "comment_id"] if of_comments else ["author_id"]
    for table in gathered(batches, [*ids, "content", *(["mark"] if of_authors else [])], ["content"]):
        kinds = {**{c: table.schema.field(c).type for c in ids}, **{c: _ARROW[t] for c, t in _columns(of_authors, of_comments).items()}}
        cut = _cut(_column(table, "content"))
        code, run = known.codes(cut[0]), run + 1
        for found in [*([_author_rows(table, cut, code, len(known.words))] if of_authors else []),
                      *(_comment_rows(table, cut, code, known, run) if of_comments else ())]:
            n = len(next(iter(found.values())))
            if n:
                yield pa.RecordBatch.from_arrays([found[c] if c in found else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))


def _columns(of_authors: bool, of_comments: bool) -> dict[str, str]:
    return {**(_OF_AUTHORS if of_authors else {}), **({**_OF_COMMENTS, **_OF_WORDS} if of_comments else {})}


def _reading(texts: DataFrame, seen: Survey, values: DataFrame | None) -> tuple[Callable[[DataFrame], DataFrame], Broadcast]:
    """What ``_read`` says of texts: of their authors if they have a mark, of comments if they have a comment_id, with
    the ``values`` of words. Also the common words."""
    words, has = _common(seen.words), F.lit(False)
    if values is None:
        table = words.select("word", "uses", has.alias("has"), F.lit(0.0).alias("value"))
    else:
        worth = values.select(F.col("word").alias("_lower"), "value")
        table = words.join(worth, F.lower("word") == F.col("_lower"), "left").select(
            "word", "uses", F.col("_lower").isNotNull().alias("has"), F.coalesce("value", F.lit(0.0)).alias("value"))
    table = table.toArrow().sort_by([("uses", "descending"), ("word", "ascending")])
    known = texts.sparkSession.sparkContext.broadcast(Known.of(
        _column(table, "word"), _column(table, "has").to_numpy(zero_copy_only=False), _column(table, "value").to_numpy(zero_copy_only=False)))
    of_authors, of_comments = "mark" in texts.columns, "comment_id" in texts.columns
    kinds = {c: texts.schema[c].dataType.simpleString() for c in ("author_id", "comment_id") if c in texts.columns}
    kinds.update(_columns(of_authors, of_comments))
    return lambda some: some.mapInArrow(
        lambda batches: _read(batches, known.value, of_authors, of_comments), ", ".join(f"{c} {t}" for c, t in kinds.items())), known


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of every line of some texts, and the distinct lines; an empty one counts."""
    split = pc.split_pattern(texts, "\n")
    coded = split.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    return row, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _met(rows: pa.Table) -> pa.RecordBatch:
    """Distinct texts, distinct words, words and links of each author of some compacted rows."""
    authors = _column(rows, "author_id").dictionary_encode()
    of, n = authors.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(authors.dictionary)

    def distinct(row: np.ndarray, number: np.ndarray) -> np.ndarray:
        return np.bincount(_once(of[row] << 32 | number) >> 32, minlength=n)

    numbers, bounds = _unpacked(_column(rows, "codes"))
    words = distinct(np.repeat(np.arange(len(rows)), np.diff(bounds)), numbers)
    row, line, lines = _lines(_column(rows, "rest"))
    real = line != pc.index(lines, "").as_py()
    marked, mark, _ = _lines(_column(rows, "marks"))
    sums = [np.bincount(of, _column(rows, c).to_numpy(zero_copy_only=False), n).astype(np.int64) for c in ("n_words", "n_links")]
    return pa.RecordBatch.from_arrays(
        [authors.dictionary, *(pa.array(c, pa.int64()) for c in (distinct(marked, mark), words + distinct(row[real], line[real]), *sums))],
        names=["author_id", "n_texts", "distinct_words", "n_words", "n_links"])


def _varied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_met`` of authors whose compacted rows follow each other: an author's rows are kept until the next one's."""
    kept: list[pa.Table] = []
    for rows in gathered(batches, ["author_id", *_OF_AUTHORS], ["codes", "rest", "marks"]):
        authors = _column(rows, "author_id")
        same = pc.equal(authors, authors[-1]).to_numpy(zero_copy_only=False)
        begin = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if begin:
            yield _met(pa.concat_tables([*kept, rows.slice(0, begin)]))
            kept = []
        elif kept and kept[-1].column("author_id")[-1] != authors[-1]:
            yield _met(pa.concat_tables(kept))
            kept = []
        kept.append(rows.slice(begin))
    if kept:
        yield _met(pa.concat_tables(kept))


def _used(batches: Iterator[pa.RecordBatch], names: pa.Array) -> Iterator[pa.RecordBatch]:
    """``author_id``, ``fact``, ``n_words``, ``n_links`` of compacted rows: what authors used, once per run, and a row without
    a fact for the numbers of words and links. A text's mark starts with a space, which no word does."""
    kind, used, counted, linked, held = None, {}, Counter(), Counter(), 0

    def flush():
        facts, none = sum(map(len, used.values())), [None] * len(counted)
        rows = pa.RecordBatch.from_arrays([
            pa.array([a for a, facts in used.items() for _ in facts] + list(counted), kind),
            pa.array([fact for facts in used.values() for fact in facts] + none, pa.string()),
            pa.array([0] * facts + list(counted.values()), pa.int64()),
            pa.array([0] * facts + [linked[a] for a in counted], pa.int64())], names=["author_id", "fact", "n_words", "n_links"])
        used.clear(), counted.clear(), linked.clear()
        return rows

    for whole in batches:
        kind = whole.schema.field("author_id").type
        for start in range(0, whole.num_rows, _TEXTS):
            b = whole.slice(start, _TEXTS)
            numbers, bounds = _unpacked(b.column("codes"))
            named = names.take(pa.array(numbers)).to_pylist()
            rows = zip(*(b.column(c).to_pylist() for c in ("author_id", "n_words", "n_links", "rest", "marks")))
            for i, (author, n, links, words, marks) in enumerate(rows):
                facts = used.setdefault(author, set())
                before = len(facts)
                facts.update(words.split(), (" " + mark for mark in marks.split("\n")), named[bounds[i]:bounds[i + 1]])
                counted[author] += n
                linked[author] += links
                held += len(facts) - before
            if held >= _FACTS:
                held = 0
                yield flush()
    if used:
        yield flush()


def variety(texts: DataFrame, seen: Survey | None = None) -> DataFrame:
    """``author_id``, ``n_texts``, ``distinct_words``, ``n_words``, ``n_links`` of (author_id, content, mark), where
    equal texts have equal marks. No author is null.

    Tasks send on each author's distinct words and marks, common words as one to three bytes. An author's
    come together in one task, which sends on four numbers. Authors with more text than a part are left
    out there: what their tasks send is rebalanced, so that adaptive execution splits it, and counted by a
    shuffle. The rebalance goes by a hash that no later step sees: by ``author_id`` itself, Spark would
    count on it as a partitioning and keep a hot author in one task.
    """
    seen = seen or survey(texts)
    compacted, known = _reading(texts.select("author_id", "content", "mark"), seen, None)
    return _varieties(texts, seen, compacted, known)


def _varieties(rows: DataFrame, seen: Survey, compacted: Callable[[DataFrame], DataFrame], known: Broadcast) -> DataFrame:
    """``variety`` of texts, or of what was read of them, which ``compacted`` turns into rows of their authors."""
    kind = rows.schema["author_id"].dataType.simpleString()
    parts = _parts(seen.sizes.agg(F.sum("size")).first()[0], rows)
    large = seen.sizes.where(F.col("size") > _part_bytes(rows)).select("author_id")
    light = rows.join(large, "author_id", "left_anti") if not large.isEmpty() else rows
    done = compacted(light).repartition(parts, "author_id").sortWithinPartitions("author_id").mapInArrow(
        _varied, f"author_id {kind}, n_texts long, distinct_words long, n_words long, n_links long")
    if large.isEmpty():
        return done
    is_text = F.startswith("fact", F.lit(" "))
    spread = compacted(rows.join(large, "author_id", "left_semi")).withColumn("_near", F.xxhash64("author_id")).hint(
        "rebalance", "_near").drop("_near").mapInArrow(
        lambda batches: _used(batches, known.value.words), f"author_id {kind}, fact string, n_words long, n_links long")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_links")]
    return done.unionByName(
        spread.groupBy("author_id", "fact").agg(*sums).groupBy("author_id").agg(
            F.count_if(is_text).alias("n_texts"), F.count_if(~is_text).alias("distinct_words"), *sums))


def _part_bytes(df: DataFrame) -> int:
    """Bytes of text in a part: the session's advisory size of a partition."""
    number, unit = re.match(r"(\d+)\s*([kmgt]?)", df.sparkSession.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes").lower()).groups()
    return max(1, int(number) << 10 * " kmgt".index(unit or " "))


def _parts(size: int | None, df: DataFrame) -> int:
    """As many parts as so much text makes, of which about a quarter is sent, the session's shuffle partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // (4 * _part_bytes(df))))


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``run``, ``number``, ``word`` of the words that are not common, one a row."""
    for batch in batches:
        for i in range(batch.num_rows):
            run, first, words = (batch.column(c).slice(i, 1) for c in ("run", "first", "words"))
            found = pc.split_pattern(words, "\n").flatten()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(found), run[0].as_py())),
                pa.array(first[0].as_py() + np.arange(len(found), dtype=np.int32)), found], names=["run", "number", "word"])


def _score(texts: pa.Table, known: pa.Table) -> pa.Table:
    """Per text of a run the sum and number of the values of its ``known`` words."""
    data, bounds = _raw(_column(texts, "open"))
    sizes, numbers = np.diff(bounds) // 4, np.frombuffer(data.tobytes(), np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place, size = _column(known, "number").to_numpy(zero_copy_only=False), 1 + int(numbers.max(initial=-1))
    size = max(size, 1 + int(place.max(initial=-1)))
    has, value = np.zeros(size, bool), np.zeros(size)
    has[place], value[place] = True, _column(known, "value").to_numpy(zero_copy_only=False)
    row, numbers = row[has[numbers]], numbers[has[numbers]]
    return pa.table([
        texts.column("author_id"), texts.column("comment_id"), pa.array(np.bincount(row, value[numbers], len(sizes)).astype(float)),
        pa.array(np.bincount(row, minlength=len(sizes)))], names=["author_id", "comment_id", "total", "hits"])


def word_totals(texts: DataFrame, values: DataFrame, seen: Survey | None = None) -> DataFrame:
    """``author_id``, ``comment_id``, ``total``, ``hits`` of (author_id, comment_id, content): the sum and
    number of the values of each text's words, in lower case, that ``values`` (word, value; unique words) holds. A text
    may have two rows, which add up, or none without such a word.

    The common words go to all tasks, with a value or without. The words that this leaves are numbered in runs of
    bounded size: a run's distinct words meet the table in a join, and what they found there comes back to the
    run's texts as its own small table: neither the words nor the table need fit anywhere.
    """
    seen, values, texts = seen or survey(texts), stage(values, "values"), texts.select("author_id", "comment_id", "content")
    return _totals(stage(_reading(texts, seen, values)[0](texts), "settled"), values)


def _totals(rows: DataFrame, values: DataFrame) -> DataFrame:
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("author_id", "comment_id"))
    settled = rows.where("hits is not null")
    asked = rows.where("words is not null").select("run", "first", "words").mapInArrow(_asked, "run long, number int, word string")
    worth = values.select(F.col("word").alias("_lower"), "value")
    known = asked.join(worth, F.lower("word") == F.col("_lower")).select("run", "number", "value")
    left = settled.where(F.octet_length("open") > 0).select("run", "author_id", "comment_id", "open")
    scored = left.groupBy("run").cogroup(known.groupBy("run")).applyInArrow(_score, f"{kinds}, total double, hits long")
    return settled.select("author_id", "comment_id", "total", "hits").unionByName(scored)


def variety_and_totals(texts: DataFrame, values: DataFrame, seen: Survey) -> tuple[DataFrame, DataFrame]:
    """``variety`` and ``word_totals`` of (author_id, comment_id, content, mark), which are read and cut into words once.
    What was read is stored: an author's distinct words as bytes, and of a comment its total and what is open."""
    values, texts = stage(values, "values"), texts.select("author_id", "comment_id", "content", "mark")
    read, known = _reading(texts, seen, values)
    rows = stage(read(texts), "words")
    of_authors = rows.where("n_words is not null").select("author_id", *_OF_AUTHORS)
    return _varieties(of_authors, seen, lambda some: some, known), _totals(rows, values)
