"""Vectorised words and word hashes of Arrow string columns.

A word is ``[^\\x20\\x09-\\x0D]+``: the separators are six ASCII bytes, so words
can be found on the UTF-8 bytes without decoding.  A word's hash is a
polynomial over a table of random 64-bit values (one per byte), computed for
all words of a batch at once from one running sum, then mixed.  The same word
has the same hash in every batch, task and run.  Two different words collide
with a probability of about 2**-63.

Texts are worked on in pieces of about ``PIECE`` bytes that end at a
separator, so the working memory does not follow the length of a text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C17 | 3)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEP = np.zeros(256, dtype=bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """Words of a batch, in text order."""

    row: np.ndarray      # int64: row of the word's text in the batch
    start: np.ndarray    # int64: first byte, in the batch's buffer
    end: np.ndarray      # int64: byte behind the last
    hash: np.ndarray     # uint64
    first: np.ndarray    # int64, rows + 1: index of each row's first word


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows in them) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (all bits depend on all bits)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + (PIECE >> 2))
        up = np.full(n, _BASE, dtype=np.uint64)
        down = np.full(n, _BASE_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def _hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of ``buf[start:end]`` for every span."""
    up, down = _power_tables(len(buf))
    run = np.empty(len(buf) + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(_VALUES[buf] * up[:len(buf)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def _pieces(buf: np.ndarray, offsets: np.ndarray):
    """(from, to) of pieces that end at a row's end or at a separator."""
    n, at = len(buf), 0
    while at < n:
        to = min(n, at + PIECE)
        if to < n:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:                                  # inside one long text
                stop = int(offsets[k + 1])
                while to < stop and not _SEP[buf[to]]:
                    to += 1
        yield at, to
        at = to


def spans(column: pa.Array, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Hashes of byte spans (ascending, not overlapping by pieces: each lies in
    one word) of a string column; ``fold`` maps bytes before hashing."""
    buf, offsets = utf8(column)
    out = np.empty(len(start), dtype=np.uint64)
    for a, b in _pieces(buf, offsets):
        lo, hi = np.searchsorted(start, [a, b])
        part = buf[a:b] if fold is None else fold[buf[a:b]]
        out[lo:hi] = _hash_spans(part, start[lo:hi] - a, end[lo:hi] - a)
    return out


def words(column: pa.Array, lower: bool = False, hashed: bool = True,
          strip: np.ndarray | None = None) -> Words:
    """All words of a string column.  ``lower`` folds A-Z before hashing (byte
    positions stay those of the unchanged text); ``strip`` marks bytes that are
    separators too."""
    buf, offsets = utf8(column)
    sep = _SEP if strip is None else _SEP | strip
    starts, ends, hashes = [], [], []
    for a, b in _pieces(buf, offsets):
        part = buf[a:b]
        inside = np.empty(len(part) + 2, dtype=bool)
        inside[0] = inside[-1] = False
        np.logical_not(sep[part], out=inside[1:-1])
        begins = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        lo, hi = np.searchsorted(offsets, [a, b])
        edge = offsets[lo:hi + 1]
        edge = edge[(edge > a) & (edge < b)] - a       # texts that meet without a separator
        begins[edge] = inside[1:-1][edge]
        closes[edge - 1] = inside[1:-1][edge - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        if hashed:
            hashes.append(_hash_spans(LOWER[part] if lower else part, s, e))
        starts.append(s + a)
        ends.append(e + a)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(len(start) if not hashed else 0, np.uint64)
    first = np.searchsorted(start, offsets, "left").astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(first))
    return Words(row, start, end, h, first)


def windows(w: Words, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``size`` words of one row.
    Each ``salt`` is another hash function."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    by = np.uint64(0xD6E8FEB86659FD93 + salt * 0x9E3779B97F4A7C16 & (1 << 64) - 1)
    h = np.full(n, np.uint64(salt * 64 + size), dtype=np.uint64)
    for k in range(size):
        h = h * by + w.hash[k:k + n]
    at = np.flatnonzero(w.row[:n] == w.row[size - 1:])
    return at, mix(h[at])


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return h.view(np.int64)
