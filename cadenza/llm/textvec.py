"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes outside space and \\t..\\r, with A-Z lower-cased on request.  A word's hash is a
polynomial over its bytes modulo 2**64, obtained for all words of a block from one running sum, then mixed.  With 64
bits, a hundred million distinct values collide with probability below one in a thousand.  A hash doesn't depend on where
its word lies, so a long document's words are hashed in parts of `BLOCK_BYTES`, and what is held of a block (`BLOCK_BYTES` of
text, or one longer document) is a few bytes for each of its own, besides arrays of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)

NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _byte_values(fold: bool) -> np.ndarray:
    b = np.arange(256)
    if fold:
        b = np.where((b >= 65) & (b <= 90), b + 32, b)
    return mix(b.astype(np.uint64) + np.uint64(1))


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n + 1:
        size = max(n, BLOCK_BYTES) + 1
        for name, base in (("up", _MULT), ("down", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(data)
    up, down = _power_tables(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[fold][data] * up[:n], dtype=np.uint64, out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set in each of the ranges, which ascend and don't overlap; no array as long as `flags` is made."""
    out = np.zeros(len(start), np.int64)
    full = np.flatnonzero(end > start)
    if len(full):
        edge = np.stack([start[full], end[full]], axis=1).reshape(-1)
        out[full] = np.add.reduceat(flags, edge[:-1] if edge[-1] == len(flags) else edge, dtype=np.int64)[::2]
    return out


class Block(NamedTuple):
    """Consecutive documents: rows `first`..`first + n` of the batch, the block's bytes, and its words."""

    first: int
    n: int
    data: np.ndarray  # uint8
    doc_start: np.ndarray  # int64, n
    doc_end: np.ndarray  # int64, n
    start: np.ndarray  # int64 per word
    end: np.ndarray
    offsets: np.ndarray  # int64, n + 1: words of document i are offsets[i]..offsets[i + 1]

    def hashes(self, fold: bool = True) -> np.ndarray:
        return self.span_hashes(self.start, self.end, fold)

    def span_hashes(self, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
        """Hashes of any byte ranges of the block; of a long one in parts, if they ascend."""
        if len(self.data) <= 2 * BLOCK_BYTES or (start[1:] < start[:-1]).any() or (end[1:] < end[:-1]).any():
            return _span_hashes(self.data, start, end, fold)
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            lo = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, lo + BLOCK_BYTES, "right")))
            out[i:j] = _span_hashes(self.data[lo : int(end[j - 1])], start[i:j] - lo, end[i:j] - lo, fold)
            i = j
        return out

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every \n-split line; an empty document has one empty line."""
        cut = np.flatnonzero(self.data == 10)
        doc = np.searchsorted(self.doc_start, cut, "right") - 1
        # of documents that start at one place, all but the last are empty; bytes between documents belong to none
        inside = (doc >= 0) & (cut < self.doc_end[doc]) if len(cut) else np.zeros(0, bool)
        cut, doc = cut[inside], doc[inside]
        start = np.concatenate((self.doc_start, cut + 1))
        owner = np.concatenate((np.arange(self.n), doc))
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        last = np.ones(len(owner), bool)
        last[:-1] = owner[1:] != owner[:-1]
        end = np.empty(len(start), np.int64)
        end[:-1] = start[1:] - 1
        end[last] = self.doc_end[owner[last]]
        return start, end, owner

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        """The block-relative document of each word."""
        return np.repeat(np.arange(self.n), self.counts())


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and where each row's text starts and ends; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        raise TypeError(f"text column expected, not {column.type}")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start, end = off[:-1].copy(), off[1:].copy()
    if column.null_count:
        gone = column.is_null().to_numpy(zero_copy_only=False)
        end[gone] = start[gone]
    return raw, start, end


def split(data: np.ndarray, doc_start: np.ndarray, doc_end: np.ndarray, first: int = 0) -> Block:
    """The words of documents that lie one after another in `data`."""
    n = len(doc_start)
    inside = NONSPACE[data]
    if doc_start.size and (doc_start[1:] > doc_end[:-1]).any():  # bytes under a null row belong to no document
        owned = np.zeros(len(data) + 1, np.int64)
        np.add.at(owned, doc_start, 1)
        np.add.at(owned, doc_end, -1)
        inside &= np.cumsum(owned)[:-1] > 0
    fresh = np.zeros(len(data) + 1, bool)
    fresh[doc_start] = True
    fresh[doc_end] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | fresh[:-1]))
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    edges = np.empty(n + 1, np.int64)
    edges[:-1] = np.searchsorted(start, doc_start)
    edges[-1] = np.searchsorted(start, doc_end[-1]) if n else 0
    return Block(first, n, data, doc_start, doc_end, start, end, edges)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The batch in blocks of about `size` bytes, every document whole."""
    data, start, end = spans(column)
    i, n = 0, len(start)
    while i < n:
        j = int(np.searchsorted(end, start[i] + size, "right"))
        j = min(n, max(i + 1, j))
        lo, hi = int(start[i]), int(end[i:j].max())
        yield split(data[lo:hi], start[i:j] - lo, np.maximum(start[i:j], end[i:j]) - lo, i)
        i = j


def shingles(h: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k-word window and each document's range of them; a shorter document's words form one window."""
    n = np.diff(offsets)
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(per, out=bounds[1:])
    out = np.zeros(int(bounds[-1]), np.uint64)
    if len(h) >= k:
        g = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            g = g * _SHINGLE + h[j : len(h) - k + 1 + j]
        whole = np.flatnonzero(n >= k)
        at = np.repeat(offsets[whole] - np.concatenate(([0], np.cumsum(per[whole])[:-1])), per[whole]) + np.arange(int(per[whole].sum()))
        to = np.repeat(bounds[whole] - np.concatenate(([0], np.cumsum(per[whole])[:-1])), per[whole]) + np.arange(int(per[whole].sum()))
        out[to] = mix(g[at])
    for i in np.flatnonzero((n > 0) & (n < k)):
        g = np.uint64(n[i])
        with np.errstate(over="ignore"):
            for x in h[offsets[i] : offsets[i + 1]]:
                g = g * _SHINGLE + x
        out[bounds[i]] = mix(np.array([g], np.uint64))[0] ^ np.uint64(0x5555555555555555)
    return out, bounds
