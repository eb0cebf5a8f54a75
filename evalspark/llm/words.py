"""Vectorised word helpers for Arrow batches of text.

A word is a run of bytes other than space and 0x09-0x0D, so words of UTF-8
text can be found on its bytes. All functions work on one bounded chunk of
rows at a time (``chunks``), whatever the size of the Arrow batch; a single
text longer than the bound is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 2_000_000

_BASE = 0x9E3779B97F4A7C15  # odd
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


_POW = _powers(_BASE, 1 << 16)
_INV = _powers(pow(_BASE, -1, 1 << 64), 1 << 16)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n bytes."""
    global _POW, _INV
    if n > len(_POW):
        size = 1 << int(n - 1).bit_length()
        _POW, _INV = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def multipliers(n: int, seed: int) -> list:
    """n odd 64-bit constants made from a seed."""
    x = mix(np.arange(1, n + 1, dtype=U64) + U64(seed * 0x51ED27) * U64(0x2545F4914F6CDD1D))
    return [U64(int(v) | 1) for v in x]


@dataclass
class Words:
    """Words of the rows of one chunk, in order.

    data: bytes of all rows, each row followed by one separator byte;
    start/end: byte span of each word; hash: 64-bit hash of each word;
    first: index of the first word of each row (one entry more than rows).
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators for words of letters and digits only; bytes above 0x7F count as letters.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[ord("A"):ord("Z") + 1] += 32


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array with at most ``limit`` bytes each (one row at least)."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def chunk_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows, each followed by a space (null: none), and the end of each row."""
    filled = pc.fill_null(texts, "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    lengths = pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(filled)], filled), " ")
    raw = joined[0].as_buffer() if len(filled) else pa.py_buffer(b"")
    data = np.empty(int(lengths.sum()) + len(filled), dtype=np.uint8)
    data[:-1] = np.frombuffer(raw, dtype=np.uint8)
    data[-1:] = 0x20
    return data, np.cumsum(lengths + 1) - 1


def split_words(texts: pa.Array, lower: bool = False, separators: np.ndarray = _SEP) -> Words:
    """Words of the rows of one chunk; ``lower`` maps A-Z to a-z (ASCII only). ``separators`` tells
    for each byte whether it ends a word; the space must be one."""
    if not len(texts):
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint8), none, none, np.zeros(0, dtype=U64), np.zeros(1, dtype=np.int64))
    data, row_end = chunk_bytes(texts)
    if lower:
        data = _LOWER[data]
    word = np.empty(len(data) + 1, dtype=bool)
    word[0] = False
    np.logical_not(separators[data], out=word[1:])
    edges = np.flatnonzero(word[1:] != word[:-1])  # the last byte is a separator, so edges come in pairs
    start, end = edges[::2], edges[1::2]
    powers, inverse = _tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers[:len(data)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * inverse[start])
    first = np.concatenate([[0], np.searchsorted(start, row_end)])
    return Words(data, start, end, h, first)


def ngram_hashes(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of the n consecutive word hashes from each position (len(h) - n + 1 values)."""
    if len(h) < n:
        return np.zeros(0, dtype=U64)
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        out = np.zeros(m, dtype=U64)
        for k, c in enumerate(multipliers(n, seed)):
            out += h[k:k + m] * c
        return mix(out)


def window_starts(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and row of every n-word window that lies in one row."""
    row = w.row_of_word()
    ok = np.arange(len(row)) + n <= w.first[1:][row] if len(row) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(ok)
    return at, row[at]
