"""Elias-Fano coding of a non-decreasing sequence of unsigned integers, with vectorised access and search.

A value's `low` bits are packed side by side; its upper part is unary in a bit vector (element i sets bit upper + i), whose
ones before each 64-bit word are kept.  Space is about low + 3 bits per element.
"""

from __future__ import annotations

import numpy as np

_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _on = [k for k in range(8) if _b >> k & 1]
    _SELECT[_b, : len(_on)] = _on
_U = np.uint64
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)


def pack_bits(x: np.ndarray, width: int) -> np.ndarray:
    """`width` low bits of each value, one after another from the lowest bit up, and 8 spare bytes."""
    if not width:
        return np.zeros(8, np.uint8)
    out, bits = [], np.arange(width, dtype=_U)
    for i in range(0, len(x), 1 << 17):
        out.append(np.packbits((x[i : i + (1 << 17), None] >> bits & _U(1)).astype(np.uint8).reshape(-1), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


def encode(x: np.ndarray, name: str = "") -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and numbers that `EliasFano` takes."""
    x = np.asarray(x, _U)
    n = len(x)
    first = int(x[0]) if n else 0
    y = x - _U(first)
    width = max(0, min(56, ((int(y[-1]) // n).bit_length() - 1) if n and int(y[-1]) >= n else 0))
    upper = (y >> _U(width)).astype(np.int64)
    at = upper + np.arange(n)
    words = (int(at[-1]) // 64 + 2) if n else 1
    raw = np.zeros(words * 64, bool)
    raw[at] = True
    vector = np.packbits(raw, bitorder="little")
    ones = np.zeros(words + 1, np.int64)
    np.cumsum(raw.reshape(-1, 64).sum(axis=1), out=ones[1:])
    kind = np.uint32 if n < 1 << 32 else np.uint64
    return {f"{name}low": pack_bits(y, width), f"{name}vector": vector, f"{name}ones": ones.astype(kind)}, {f"{name}n": n, f"{name}width": width, f"{name}first": first, f"{name}top": int(upper[-1]) if n else -1}


class EliasFano:
    def __init__(self, low: np.ndarray, vector: np.ndarray, ones: np.ndarray, n: int, width: int, first: int, top: int):
        self.n, self.width, self.first, self.top = n, width, first, top
        self.low = np.ndarray((max(0, len(low) - 7),), "<u8", low.data, strides=(1,))
        self.vector, self.ones = vector, ones
        self.bits = np.ndarray((max(0, len(vector) - 7),), "<u8", vector.data, strides=(1,))
        self.zeros = None
        self.mask = _U((1 << width) - 1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        bit = i * self.width
        return self.low[bit >> 3] >> (bit & 7).astype(_U) & self.mask

    def _in_word(self, word: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Position, within 64 bits, of the k-th one (or, flipped, zero): by sums of bytes, then by table."""
        x = self.vector.view("<u8")[word]
        if flip:
            x = ~x
        k = k.astype(_U)
        s = x - (x >> _U(1) & _U(0x5555555555555555))
        s = (s & _U(0x3333333333333333)) + (s >> _U(2) & _U(0x3333333333333333))
        s = (s + (s >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # byte i: ones in bytes 0 to i
        full = ((k * _ONES | _TOPS) - s & _TOPS) >> _U(7)  # bytes that end at k or before
        place = (full * _ONES >> _U(56)) * _U(8)
        inner = k - (s << _U(8) >> place & _U(0xFF))
        return (place + _SELECT[(x >> place & _U(0xFF)).astype(np.int64), inner.astype(np.int64)]).astype(np.int64)

    def _run(self, at: np.ndarray, flip: bool) -> tuple[np.ndarray, np.ndarray]:
        """How many zeros (or, flipped, ones) follow from bit `at` on, and whether they end within the 57 bits or more read."""
        shift = (at & 7).astype(_U)
        x = self.bits[at >> 3] >> shift
        if flip:
            x = ~x
        n = np.bitwise_count((x & (_U(0) - x)) - _U(1)).astype(np.int64)
        return n, n < 64 - shift.astype(np.int64)

    def _select(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        return word * 64 + self._in_word(word, i - self.ones[word].astype(np.int64), False)

    def _values(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (((at - i).astype(_U) << _U(self.width)) | self._low(i)) + _U(self.first)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return self._values(i, self._select(i))

    def access_pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1: the second one's bit is the next that is set."""
        i = np.asarray(i, np.int64)
        at = self._select(i)
        gap, near = self._run(at + 1, False)
        after = at + 1 + gap
        far = np.flatnonzero(~near)
        if len(far):
            after[far] = self._select(i[far] + 1)
        return self._values(i, at), self._values(i + 1, after)

    def _upto(self, h: np.ndarray) -> np.ndarray:
        """Elements whose upper part is h or less, for -1 <= h <= top."""
        out = np.zeros(len(h), np.int64)
        out[h >= self.top] = self.n
        m = np.flatnonzero((h >= 0) & (h < self.top))
        if len(m):
            if self.zeros is None:
                self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
            k = h[m]
            word = np.searchsorted(self.zeros, k, "right") - 1
            out[m] = word * 64 + self._in_word(word, k - self.zeros[word], True) - k
        return out

    def _among(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements whose upper part is h, for 0 <= h <= top: the ones that follow the zero before."""
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
        k = h - 1
        word = np.searchsorted(self.zeros, k, "right") - 1
        at = np.where(k >= 0, word * 64 + self._in_word(np.maximum(word, 0), np.maximum(k - self.zeros[np.maximum(word, 0)], 0), True), -1)
        lo = at - k
        n, near = self._run(at + 1, True)
        hi = np.minimum(lo + n, self.n)
        far = np.flatnonzero(~near)
        if len(far):
            hi[far] = self._upto(h[far])
        return lo, hi

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The position of each value, within begin..end if given, or -1: a search for its successor among equal upper parts."""
        x = np.asarray(x, _U)
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        y = x - _U(self.first)
        h = (y >> _U(self.width)).astype(np.int64)
        ok = np.flatnonzero((x >= _U(self.first)) & (h >= 0) & (h <= self.top))
        y, h = y[ok], h[ok]
        lo, hi = self._among(h)
        if begin is not None:
            lo, hi = np.maximum(lo, begin[ok]), np.minimum(hi, end[ok])
        live = np.flatnonzero(lo < hi)
        lo, hi, want = lo[live], hi[live], (y & self.mask)[live]
        live = ok[live]
        wide = np.flatnonzero(hi - lo > 8)
        while len(wide):  # halve long ranges; short ones are read through
            mid = (lo[wide] + hi[wide]) >> 1
            less = self._low(mid) < want[wide]
            lo[wide] = np.where(less, mid + 1, lo[wide])
            hi[wide] = np.where(less, hi[wide], mid + 1)
            wide = wide[hi[wide] - lo[wide] > 8]
        while len(live):
            value = self._low(lo)
            hit = value == want
            out[live[hit]] = lo[hit]
            more = np.flatnonzero((value < want) & (lo + 1 < hi))
            live, lo, hi, want = live[more], lo[more] + 1, hi[more], want[more]
        return out
