"""Hashes of words, windows and bytes of a batch of texts, a few array passes for all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed together; a longer text is hashed by itself.
CHUNK = 1 << 18
#: Bytes of a word from which on it is hashed by itself.
LONG_WORD = 32

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOLS = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that leaves no bit where it was (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * len(_POWERS[0]), CHUNK + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n + 1], _POWERS[1][:n + 1]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """sums[e] - sums[s], times the inverse's power s, is a hash of symbols[s:e]."""
    up, _ = powers(len(symbols))
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:-1], out=sums[1:])
    return sums


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets): runs of rows with their UTF-8 bytes; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes that no arrangement of equal letters can cancel out."""
    raw = data.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist())], np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word; words end with their row."""
    n = len(data)
    gap = _GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | edge[:n])) if n else np.empty(0, np.int64)
    ends = np.flatnonzero(~gap & np.concatenate([gap[1:] | edge[1:n], [True]])) + 1 if n else np.empty(0, np.int64)
    sums = prefix_sums(_SYMBOLS[_LOWER[data] if lower else data])
    _, down = powers(n)
    hashes = mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
    # The polynomial is one modulo a power of 2: two letters can be arranged so that long words agree.
    long = np.flatnonzero(ends - begins > LONG_WORD)
    if len(long):
        hashes[long] = digests(_LOWER[data] if lower else data, begins[long], ends[long])
    row = np.searchsorted(offsets, begins, side="right") - 1
    return hashes, row, begins, ends


def set_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set; the number of bits is a power of two."""
    at = mix(keys) & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
