"""The contracts of the queries, by brute force in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

GAP = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    ws = words(text)
    seen, covered = defaultdict(list), set()
    for i in range(len(ws) - 2):
        seen[tuple(ws[i:i + 3])].append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for w in ws for c in w),
            len(lines) - len(set(lines)), len(covered))


def tokenizer(name):
    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.no_truncation()
    made.no_padding()
    return made


def pieces(rows, capacity=1024):
    tokens, out = tokenizer("byte_bpe_50k.json"), []
    for doc_id, text in rows:
        ids = tokens.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            out.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def licenses(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(i, label) for phrase, label in phrases.items() for i in range(len(ws))
              if ws[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def repeats(rows, length=200):
    count = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        count.update(raw[i:i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if count[raw[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def encoded(rows):
    tokens, out = tokenizer("word_bpe_49k.json"), []
    for doc_id, text in rows:
        ids = tokens.encode(text or "", add_special_tokens=False).ids
        decoded = tokens.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return out


def passages(rows, window=50):
    first = {}
    for doc_id, text in rows:
        ws = words(text)
        for i in range(len(ws) - window + 1 if doc_id is not None else 0):
            key = tuple(ws[i:i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        ws = words(text)
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1 if doc_id is not None else 0):
            if first[tuple(ws[i:i + window])] < doc_id:
                gone[i:i + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((doc_id, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def link_classes(rows):
    sets = []
    for doc_id, text in rows:
        ws = (text or "").encode().lower().split()
        sets.append((doc_id, {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()))
    parent = {doc_id: doc_id for doc_id, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) \
                    and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return [(doc_id, len(x), root(doc_id)) for doc_id, x in sets]


def token_counts(rows):
    tokens = tokenizer("byte_bpe_50k.json")
    tokens.encode_special_tokens = True
    return [(doc_id, len(tokens.encode(text or "", add_special_tokens=False).ids)) for doc_id, text in rows]


def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, more=0):
    values = [row[name] for name in ("doc_id", "source", "lang", "n_chars", "text")]
    if values[3] is not None:
        values[3] += more
    return _digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_digest(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def _siblings(levels, i):
    path = []
    for level in levels[:-1]:
        path.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else ""))
        i //= 2
    return path


def manifest(rows):
    """Rows of the Merkle manifest, from dictionaries with the columns of documents."""
    langs = {}
    for row in rows:
        langs.setdefault(row["lang"], []).append(row)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        trees.append((own, _levels([_leaf(r) for r in own])))
    top = _levels([levels[-1][0] for _, levels in trees]) if trees else []
    found = []
    for number, (own, levels) in enumerate(trees):
        for i, row in enumerate(own):
            path = _siblings(levels, i) + _siblings(top, number)
            changed = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            folded = _leaf(row, 1 if changed else 0)
            for on_left, other in path:
                folded = _digest(other, folded) if on_left else _digest(folded, other)
            found.append((row["doc_id"], _leaf(row), levels[-1][0], top[-1][0], _digest(*[s for _, s in path]), folded, folded == top[-1][0]))
    return found


def phrases(rows, least=10, top=2000):
    """Collocations of (lang, text) rows: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lowered):
            words = [w for w in re.split("[\\x20\\x09]+", piece) if w]
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for size in (1, 2, 3):
                own.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    found = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for phrase, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(phrase) and phrase in (q[:2], q[1:])]
            if any(100 * b >= 50 * a for b in longer):
                continue
            cuts = [(1000000 * a * a // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, name, left, right) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, name.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)
