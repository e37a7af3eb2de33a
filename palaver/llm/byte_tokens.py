"""Ids of the public byte-level vocabulary, a piece of text at a time."""

from __future__ import annotations

import base64
import json

import numpy as np
import regex

from palaver.llm.bpe_automaton import tokenizer_path

#: Name of the special token that ends a document, as the tokenizer file has it.
END = "<|endoftext|>"

#: Pieces whose ids a worker keeps, at about 200 bytes each: workers live on beside later stages.
KEPT_PIECES = 1 << 17


class ByteTokens:
    """Pre-splits and looks up the ids of every distinct piece once; the table of pieces is
    emptied when full, which changes no id. ``special``: whether the end token's name in a text
    is that token, as the tokenizers library has it, or ordinary text."""

    def __init__(self, special: bool):
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
            self.end = next(x["id"] for x in json.load(f)["added_tokens"] if x["content"] == END)
        core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.core, self.special = core._core_bpe, special
        self.split = regex.compile(public_tokenizers.PATTERN.replace(r"^\s", r"^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        if len(self.pieces) >= KEPT_PIECES:
            self.pieces.clear()
        ids = self.pieces[piece] = np.array(self.core.encode_single_piece(piece.encode()), "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.special and END in text:
            return np.array([self.end], "<u4").tobytes().join([self.encode(x) for x in text.split(END)])
        known = self.pieces
        return b"".join([known.get(x) or self.piece(x) for x in self.split.findall(text)])


_TOKENS: dict[bool, ByteTokens] = {}


def byte_tokens(special: bool) -> ByteTokens:
    """One per worker."""
    if special not in _TOKENS:
        _TOKENS[special] = ByteTokens(special)
    return _TOKENS[special]
