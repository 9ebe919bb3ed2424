"""Elias-Fano coded monotone sequences in numpy arrays, asked for whole arrays at once."""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64
HEAD = struct.Struct("<QQQQ")


ONES, HIGHS = U64(0x0101010101010101), U64(0x8080808080808080)
#: Place of the k-th set bit of each byte, 8 where there is none.
IN_BYTE = np.array([[*[i for i in range(8) if b >> i & 1], *[8] * 8][k] for b in range(256) for k in range(8)], dtype=np.uint8)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word: bits are counted in all bytes at once, then looked up in one."""
    with np.errstate(over="ignore"):
        k = k.astype(U64)
        x = word - (word >> U64(1) & U64(0x5555555555555555))
        x = (x & U64(0x3333333333333333)) + (x >> U64(2) & U64(0x3333333333333333))
        upto = (x + (x >> U64(4)) & U64(0x0F0F0F0F0F0F0F0F)) * ONES
        shift = np.bitwise_count(((k * ONES | HIGHS) - upto) & HIGHS).astype(U64) << U64(3)
        rest = k - (upto << U64(8) >> shift & U64(255))
        return (shift + IN_BYTE[(word >> shift & U64(255)) << U64(3) | rest]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, ones and zeros counted per word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.mask = U64((1 << low_bits) - 1)
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(U64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros((n * low_bits + 63) // 64 + 2, dtype=U64)
        if low_bits and n:
            at = np.arange(n, dtype=np.int64) * low_bits
            part = v & U64((1 << low_bits) - 1)
            shift = (at & 63).astype(U64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = at[(at & 63) + low_bits > 64]
            back = U64(64) - (over & 63).astype(U64)
            np.bitwise_or.at(low, (over >> 6) + 1, part[(at & 63) + low_bits > 64] >> back)
        place = (v >> U64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> low_bits) // 64 + n // 64 + 3, dtype=U64)
        np.bitwise_or.at(high, place >> 6, U64(1) << (place & 63).astype(U64))
        return cls(n, low_bits, low, high, cls._ranks(high))

    @staticmethod
    def _ranks(high: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]

    def dump(self) -> bytes:
        return HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.ones.tobytes()

    @classmethod
    def load(cls, data, at: int) -> tuple[EliasFano, int]:
        """From a buffer, its arrays left where they are; also where the next part starts."""
        n, low_bits, n_low, n_high = HEAD.unpack_from(data, at)
        at += HEAD.size
        low = np.frombuffer(data, "<u8", n_low, at)
        high = np.frombuffer(data, "<u8", n_high, at + 8 * n_low)
        ones = np.frombuffer(data, "<i8", n_high, at + 8 * (n_low + n_high))
        return cls(n, low_bits, low, high, ones), at + 8 * (n_low + 2 * n_high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=U64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(U64)
        # shifting by 64 is undefined: the next word is shifted in two steps
        return (self.low[word] >> shift | self.low[word + 1] << U64(1) << (U64(63) - shift)) & self.mask

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return (place - i).astype(U64) << U64(self.low_bits) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """First place of each value, -1 where it does not occur."""
        v = values.astype(U64)
        out = np.full(len(v), -1, dtype=np.int64)
        if not self.n or not len(v):
            return out
        part = (v >> U64(self.low_bits)).astype(np.int64)
        # zeros of the unary part end the groups of equal high parts; none lies beyond the last group
        asked = np.flatnonzero(part < len(self.high) * 64 - self.n)
        part, want = part[asked], v[asked] & self.mask
        stop = self._select0(part)
        start = np.where(part > 0, self._select0(np.maximum(part - 1, 0)) + 1, 0)
        lo, end = start - part, stop - part
        hi = end.copy()
        # values of a group share their high part and ascend in their low part; frequent nodes make long groups
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < want[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
            open_ = open_[lo[open_] < hi[open_]]
        inside = np.flatnonzero(lo < end)
        hit = inside[self._low(lo[inside]) == want[inside]]
        out[asked[hit]] = lo[hit]
        return out
