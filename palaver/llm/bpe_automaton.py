"""Byte-pair encoding by a tokenization automaton.

The automaton reads token labels and accepts exactly the label sequences that the merges produce.
It is compiled by gadgets, one per merge (u, v) -> w in order of rank. At first one state loops on
every base symbol. The gadget sends the u-arcs to a copy of their target that lacks the v-arc (u
followed by v is always merged), and adds to every state that still reads u and v in a row a
w-arc to where v led. So after every gadget the target of an arc depends on its label alone:

* the target of u loses v;
* the target of w starts as the target that v has at that moment;
* a state reads w from then on if it reads u at that moment.

The three facts are the whole automaton. They are kept as a table of one row per label, with its
two halves and its rank, and are read backwards for single transitions: arc n leaves the target of t
before gadget k unless merge (t, n) came earlier, and if it leaves the target that is left when the
younger of t and n is taken apart. A read transition is entered in the transition table, and a word
in the word table; both are emptied when full, which changes no result.

A word is encoded by walking arcs from its start, longest label first, along transitions that the
table has, stepping back from dead ends; every place is left at most once, and exactly one path is
accepted. Decoding emits the arcs' labels.

Null and empty texts give no tokens. Repeated rows get equal rows; a null id stays null. Columns
other than id and text are not read. Any text is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from palaver.llm.common import documents, map_batches

#: Entries after which the table of transitions and the table of words are emptied.
TABLE_SIZE = 1 << 20


#: Pre-split of the tokenizer file.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it shows, else a code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Automaton:
    """Transitions of the merges of a tokenizer file."""

    def __init__(self, model: dict):
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.labels = {i: label for label, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        size = max(self.ids.values()) + 1
        self.formed, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        for k, (a, b) in enumerate(model["merges"]):
            u, v, w = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[u, v] = k
            self.formed[w], self.left[w], self.right[w] = k, u, v
        self.longest = max(map(len, self.ids))
        self.table: dict[tuple[int, int], bool] = {}

    def arc(self, t: int, n: int) -> bool:
        """Whether label n may follow label t."""
        known = self.table.get((t, n))
        if known is None:
            if len(self.table) >= TABLE_SIZE:
                self.table.clear()
            known = self.table[t, n] = self._read(t, n)
        return known

    def _read(self, t: int, n: int) -> bool:
        before, self_merge = len(self.rank), False
        while True:
            k = self.rank.get((t, n))
            if k is not None and (k < before or self_merge and k == before):
                return False
            x, y = self.formed[t], self.formed[n]
            if x < 0 and y < 0:
                return True
            if y >= x:  # n came last: its gadget asked the state for the first half of n
                before, self_merge, n = y, True, self.left[n]
            else:  # t came last: its target began as that of its second half
                before, self_merge, t = x, False, self.right[t]

    def encode(self, word: str) -> list[int]:
        """The labels of the accepted path over a non-empty word of byte symbols."""
        n, ids, arc = len(word), self.ids, self.arc
        path: list[int] = []
        ends: list[int] = []  # where each label of the path ends
        dead: set[int] = set()
        at, stop = 0, n
        while at < n:
            step = None
            for end in range(min(stop, at + self.longest), at, -1):
                if end in dead:
                    continue
                label = ids.get(word[at:] + self.suffix if end == n else word[at:end])
                if label is not None and (not path or arc(path[-1], label)):
                    step = end
                    break
            if step is not None:
                path.append(label)
                ends.append(step)
                at, stop = step, n
            elif path:  # no way on: this place is dead for every path, as a prefix has one tokenization
                dead.add(at)
                path.pop()
                ends.pop()
                at, stop = (ends[-1] if ends else 0), at - 1
            else:
                raise ValueError(f"no path over {word!r}")
        return path


class WordCodec:
    """Normalises and pre-splits as the tokenizer file says, then walks the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.automaton = Automaton(spec["model"])
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = specials
        self.outer = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.inner = regex.compile(WORD)
        self.symbols = byte_symbols()
        self.labels = {**self.automaton.labels, **{i: s for s, i in specials.items()}}
        self.words: dict[str, tuple[bytes, str]] = {}

    def word(self, word: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, labels joined by a space)"""
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= TABLE_SIZE:
                self.words.clear()
            # Letters, digits and signs of ASCII stand for themselves.
            path = self.automaton.encode(word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode()]))
            known = self.words[word] = (np.array(path, "<u4").tobytes(), " ".join([self.labels[i] for i in path]))
        return known

    def encode_parts(self, text: str) -> list[tuple[bytes, str]]:
        out = []
        for part in self.outer.split(text) if self.outer else [text]:
            if part in self.specials:
                out.append((np.array([self.specials[part]], "<u4").tobytes(), part))
            elif part:
                # Lower case goes letter by letter: a final sigma is no exception.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                words = self.words
                out += [words.get(w) or self.word(w) for w in self.inner.findall(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([x for x, _ in self.encode_parts(text)]), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.labels[i] for i in ids])


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One codec per worker and file."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    def run(batch: pa.RecordBatch):
        words = codec(path)
        counts, ids_sha, decoded_sha = [], [], []
        for text in batch.column("text"):
            parts = words.encode_parts(text.as_py() or "")
            ids = b"".join([x for x, _ in parts])
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(" ".join([x for _, x in parts]).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text"), run,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
