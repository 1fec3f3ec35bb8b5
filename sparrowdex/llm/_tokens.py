"""Whole-column tokenising in numpy: no Python loop over words or characters.

Texts stay UTF-8 bytes. A byte is a separator (ASCII white space and control), a
word byte (ASCII letter or digit, or any byte of a non-ASCII character) or, in
tables that keep it, punctuation. A token is a longest run of one class inside
one document; only ASCII letters are folded to lower case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 2 << 20  # bytes worked on at once; a longer document is a chunk of its own

_word = np.zeros(256, np.uint8)
for _b in range(256):
    _word[_b] = 1 if _b >= 128 or chr(_b).isalnum() else 0
_runs = _word.copy()
for _b in range(33, 127):
    if not _word[_b]:
        _runs[_b] = 2
_space = np.ones(256, np.uint8)
_space[:33] = 0
_space[127] = 0
WORDS, RUNS, SPACED = _word, _runs, _space
_values = np.arange(1, 257, dtype=U)
CASED = _values.copy()
LOWER = _values.copy()
LOWER[65:91] = _values[97:123]

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_pow = _ipow = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, CHUNK + 1)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _pow, _ipow = out
    return _pow[:n], _ipow


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and offsets.size else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offs


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of whole documents."""
    data, offs = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Tokens:
    """Tokens of a chunk, in order: start and end byte, document (from 0), 64-bit hash."""

    __slots__ = ("start", "end", "doc", "hash", "n_docs", "cls")

    def __init__(self, data: np.ndarray, offs: np.ndarray, classes: np.ndarray = WORDS, values: np.ndarray = LOWER):
        n, self.n_docs = len(data), len(offs) - 1
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.hash, self.cls = np.zeros(0, U), np.zeros(0, np.uint8)
            return
        cls = np.take(classes, data)
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(cls[1:], cls[:-1], out=new[1:])
        first = offs[:-1]
        new[first[first < n]] = True
        b = np.flatnonzero(new)
        kinds = cls[b]
        keep = kinds != 0
        self.start, self.end, self.cls = b[keep], np.append(b[1:], n)[keep], kinds[keep]
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(np.searchsorted(self.start, offs)))
        p, inverse = _powers(n)
        c = np.empty(n + 1, U)
        c[0] = 0
        x = np.take(values, data)
        x *= p
        np.cumsum(x, out=c[1:])
        self.hash = mix((c[self.end] - c[self.start]) * inverse[self.start])

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def hash_words(words: list[str], classes: np.ndarray = WORDS, values: np.ndarray = LOWER) -> np.ndarray:
    """Hashes that `Tokens` gives to these words, each of which must be one token."""
    out = []
    for w in words:
        data = np.frombuffer(w.encode(), np.uint8)
        t = Tokens(data, np.array([0, len(data)]), classes, values)
        if len(t.hash) != 1:
            raise ValueError(f"not a single token: {w!r}")
        out.append(t.hash[0])
    return np.array(out, U)


def shingles(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of n tokens; a shorter document, unless
    empty, has one shingle of all its tokens."""
    h, d = t.hash, t.doc
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, U)
    counts = t.counts()
    full = max(0, len(h) - n + 1)
    x = np.full(full, n, U)
    for k in range(n):
        x = x * U(0xD6E8FEB86659FD93) + h[k : k + full]
    ok = d[:full] == d[n - 1 : n - 1 + full]
    docs, hashes = d[:full][ok], mix(x[ok])
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        starts = np.searchsorted(d, few)
        extra = np.empty(len(few), U)
        for i, (s, c) in enumerate(zip(starts, counts[few])):
            v = int(c)
            for y in h[s : s + c]:
                v = (v * 0xD6E8FEB86659FD93 + int(y)) & 0xFFFFFFFFFFFFFFFF
            extra[i] = v
        docs, hashes = np.concatenate([docs, few]), np.concatenate([hashes, mix(extra)])
        order = np.argsort(docs, kind="stable")
        docs, hashes = docs[order], hashes[order]
    return docs, hashes
