"""Elias-Fano coding of monotone sequences in numpy, with vectorised select and successor search.

A value's low bits lie packed in 64-bit words; its high bits are unary in a bit vector of at most
about two bits a value. A 32-bit count for every 512 bits is the only directory: no table holds a
64-bit offset for a value.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BLOCK = 8  # words


def _positions() -> np.ndarray:
    """Of each byte, where its k-th set bit is."""
    out = np.zeros((256, 8), np.int64)
    for byte in range(256):
        at = [i for i in range(8) if byte >> i & 1]
        out[byte, : len(at)] = at
    return out.reshape(-1)


_BIT = _positions()
_EACH = _U(0x0101010101010101)  # 1 in each byte
_TOPS = _U(0x8080808080808080)
_LANES = _U(0x00FF00FF00FF00FF)
_SPREAD = _U(0x0001000100010001)
_LANE_TOPS = _U(0x8000800080008000)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit of each word."""
    sums = words - ((words >> _U(1)) & _U(0x5555555555555555))
    sums = (sums & _U(0x3333333333333333)) + ((sums >> _U(2)) & _U(0x3333333333333333))
    sums = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH  # set bits up to each byte
    k = k.astype(_U)
    shift = np.bitwise_count(((k * _EACH | _TOPS) - sums) & _TOPS).astype(_U) * _U(8)  # bytes that end before it
    byte = (words >> shift) & _U(255)
    return shift.astype(np.int64) + _BIT[(byte * _U(8) + k - (((sums << _U(8)) >> shift) & _U(255))).astype(np.int64)]


class EliasFano:
    """``values``: ascending, repeats allowed, not negative. Build with ``of``; ``arrays`` and ``load`` store and restore."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.before = ones.astype(np.int64)
        self.zeros = np.arange(len(ones), dtype=np.int64) * (64 * _BLOCK) - self.before
        self.top = len(high) * 64 - n  # zeros in all

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, _U)
        n = len(values)
        if n and (np.diff(values.view(np.int64)) < 0).any() and (values[1:] < values[:-1]).any():
            raise ValueError("the values must ascend")
        if n >= 1 << 32:
            raise ValueError("more than 2**32 values: split them over several sequences")
        span = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (span // max(n, 1)).bit_length() - 1)
        top = int(values[-1]) >> low_bits if n else 0
        words = ((n + top + 1 + 64 * _BLOCK - 1) // (64 * _BLOCK)) * _BLOCK
        where = (values >> _U(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(words * 8, np.uint8)
        np.bitwise_or.at(bits, where >> 3, (1 << (where & 7)).astype(np.uint8))
        high = bits.view(_U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, _BLOCK).sum(1, dtype=np.int64))[:-1]]).astype(np.uint32)
        low = np.zeros((n * low_bits + 63) // 64 + 1, _U)
        if low_bits and n:
            value = values & _U((1 << low_bits) - 1)
            start = np.arange(n, dtype=np.int64) * low_bits
            word, shift = start >> 6, (start & 63).astype(_U)
            cls._scatter(low, word, value << shift)
            over = (start & 63) + low_bits > 64
            cls._scatter(low, word[over] + 1, value[over] >> (_U(64) - shift[over]))
        return cls(n, low_bits, low, high, ones)

    @staticmethod
    def _scatter(words: np.ndarray, where: np.ndarray, values: np.ndarray) -> None:
        """Ors ascending ``where``'s values in; all that goes to a word is joined first."""
        if len(where):
            first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            words[where[first]] |= np.bitwise_or.reduceat(values, first)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.size": np.array([self.n, self.low_bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def load(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = map(int, arrays[f"{name}.size"])
        return cls(n, low_bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])

    @property
    def bits(self) -> int:
        return 8 * (self.low.nbytes + self.high.nbytes + self.ones.nbytes)

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: int) -> np.ndarray:
        """Where the k-th bit that isn't ``flip`` is: the block by its directory, the word by sums of eight counts in one number."""
        block = np.searchsorted(directory, k, side="right") - 1
        rows = self.high.reshape(-1, _BLOCK)[block]
        if flip:
            rows = ~rows
        counts = np.bitwise_count(rows).view(_U)[:, 0]
        left = (k - directory[block]).astype(_U)
        even = counts & _LANES
        sums = (even + ((counts >> _U(8)) & _LANES)) * _SPREAD  # in lanes of 16 bits: set bits up to the end of each pair of words
        pair = np.bitwise_count(((left * _SPREAD | _LANE_TOPS) - sums) & _LANE_TOPS).astype(_U) * _U(16)  # of pairs that end before it
        left -= ((sums << _U(16)) >> pair) & _U(0xFFFF)
        one = (even >> pair) & _U(0xFFFF)
        second = left >= one
        left -= one * second
        word = (pair >> _U(3)).astype(np.int64) + second
        return (block * _BLOCK + word) * 64 + _select_in_word(rows[np.arange(len(k)), word], left)

    def _next(self, bit: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where the next set bit after ``bit`` is, the ``rank``-th of all; it is most often in the same word."""
        rest = (self.high[bit >> 6] >> (bit & 63).astype(_U)) >> _U(1)
        out = bit + 1 + np.bitwise_count((rest & (~rest + _U(1))) - _U(1))
        far = np.flatnonzero(rest == 0)
        if len(far):
            out[far] = self._select(rank[far], self.before, 0)
        return out

    def _value(self, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
        return ((bit - i).astype(_U) << _U(self.low_bits)) | self.low_part(i)

    def low_part(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        start = i * self.low_bits
        word, shift = start >> 6, (start & 63).astype(_U)
        over = (self.low[word + 1] << _U(1)) << (_U(63) - shift)
        return ((self.low[word] >> shift) | over) & _U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, _U)
        return self._value(self._select(i, self.before, 0), i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th values and those after them."""
        if not len(i):
            return np.zeros(0, _U), np.zeros(0, _U)
        bit = self._select(i, self.before, 0)
        return self._value(bit, i), self._value(self._next(bit, i + 1), i + 1)

    def following(self, i: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The i-th values, and a row of the ``n`` <= ``most`` ones after each; what is beyond them is the greatest number."""
        bit = self._select(i, self.before, 0)
        first, out = self._value(bit, i), np.full((len(i), most), _U(0xFFFFFFFFFFFFFFFF))
        rows = np.arange(len(i))
        for k in range(most):
            on = n[rows] > k
            rows, bit = rows[on], bit[on]
            if not len(rows):
                break
            at = i[rows] + k + 1
            bit = self._next(bit, at)
            out[rows, k] = self._value(bit, at)
        return first, out

    def all(self) -> np.ndarray:
        """All values, for a whole file at once."""
        bits = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        i = np.arange(self.n, dtype=np.int64)
        return ((bits - i).astype(_U) << _U(self.low_bits)) | self.low_part(i)

    def _group_end(self, begin: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Where groups end that begin at ``begin``: the next zero is most often in the same word."""
        bit = begin + group
        zeros = ~self.high[bit >> 6] >> (bit & 63).astype(_U)
        end = begin + np.bitwise_count((zeros & (~zeros + _U(1))) - _U(1))
        far = np.flatnonzero(zeros == 0)
        end[far] = self._select(group[far], self.zeros, 1) - group[far]
        return end

    def lookup(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the first position whose value isn't smaller (n: there is none), and whether it is equal."""
        values = np.asarray(values, _U)
        out, same = np.full(len(values), self.n, np.int64), np.zeros(len(values), bool)
        group = (values >> _U(self.low_bits)).astype(np.int64)
        inside = np.flatnonzero((group >= 0) & (group < self.top))
        if not len(inside) or not self.n:
            return out, same
        group = group[inside]
        begin = np.zeros(len(group), np.int64)
        later = np.flatnonzero(group > 0)
        begin[later] = self._select(group[later] - 1, self.zeros, 1) - (group[later] - 1)
        end = self._group_end(begin, group)
        low = values[inside] & _U((1 << self.low_bits) - 1)
        lo, hi = begin, end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self.low_part(middle) < low[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
            open_ = open_[lo[open_] < hi[open_]]
        out[inside] = np.minimum(lo, self.n)
        there = np.flatnonzero(lo < end)  # a value of the same group
        same[inside[there]] = self.low_part(lo[there]) == low[there]
        return out, same

    def successor(self, values: np.ndarray) -> np.ndarray:
        return self.lookup(values)[0]

    def find(self, values: np.ndarray) -> np.ndarray:
        """The position of each value, -1 where it is missing."""
        at, same = self.lookup(values)
        return np.where(same, at, -1)
