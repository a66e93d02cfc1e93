"""Rising whole numbers in close to the least space, and the levels of an n-gram trie made of them."""

from __future__ import annotations

import numpy as np

ONE, WORD = np.uint64(1), np.uint64(63)
HALVES = [np.uint64(h) for h in (32, 16, 8, 4, 2, 1)]


def _u64(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64)


def _add_at(words: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """words[at] += values, where `at` does not fall and sums touch no bit twice."""
    if len(at):
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words[at[first]] += np.add.reduceat(values, first)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of `bits` bits each, one after another, in 64-bit words."""
    n = len(values)
    words = np.zeros((n * bits >> 6) + 2, np.uint64)
    if bits and n:
        at = np.arange(n, dtype=np.int64) * bits
        word, shift = at >> 6, _u64(at & 63)
        _add_at(words, word, values << shift)
        over = np.flatnonzero((at & 63) + bits > 64)
        _add_at(words, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return words


def unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), np.uint64)
    first = at * bits
    word, shift = first >> 6, _u64(first & 63)
    above = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & WORD), np.uint64(0))
    return ((words[word] >> shift) | above) & np.uint64((1 << bits) - 1)


def _nth_bit(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth (from 0) set bit of each word."""
    words, nth, place = words.copy(), nth.astype(np.int64), np.zeros(len(words), np.int64)
    for half in HALVES:
        low = words & ((ONE << half) - ONE)
        count = np.bitwise_count(low).astype(np.int64)
        up = nth >= count
        nth -= np.where(up, count, 0)
        words = np.where(up, words >> half, low)
        place += np.where(up, np.int64(half), 0)
    return place


class EliasFano:
    """A sequence that does not fall: low bits packed, the rest in unary, with a directory of zeros by word.

    Three arrays of 64-bit words, which may be views of one buffer.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def of(cls, values) -> EliasFano:
        values = _u64(values)
        n = len(values)
        largest = int(values[-1]) if n else 0
        bits = max(0, (largest // max(n, 1)).bit_length() - 1)
        top = values >> np.uint64(bits)
        place = top.astype(np.int64) + np.arange(n)
        high = np.zeros(((n + (largest >> bits) + 1) >> 6) + 1, np.uint64)
        _add_at(high, place >> 6, ONE << _u64(place & 63))
        ones = np.cumsum(np.bitwise_count(high).astype(np.int64))
        zeros = 64 * np.arange(len(high), dtype=np.int64) - np.r_[0, ones[:-1]]
        return cls(n, bits, pack(values & np.uint64((1 << bits) - 1), bits), high, zeros.view(np.uint64))

    def _zero(self, nth: np.ndarray) -> np.ndarray:
        """Place of the nth zero of the unary part."""
        zeros = self.zeros.view(np.int64)
        word = np.searchsorted(zeros, nth, side="right") - 1
        return 64 * word + _nth_bit(~self.high[word], nth - zeros[word])

    def get(self, at) -> np.ndarray:
        """The numbers at the places `at`."""
        at = np.asarray(at, np.int64)
        before = 64 * np.arange(len(self.high), dtype=np.int64) - self.zeros.view(np.int64)
        word = np.searchsorted(before, at, side="right") - 1
        place = 64 * word + _nth_bit(self.high[word], at - before[word])
        return (_u64(place - at) << np.uint64(self.bits)) | unpack(self.low, self.bits, at)

    def successor(self, values, start=None, end=None) -> np.ndarray:
        """Place of the first number that is not below each value, among the places from `start` up to `end`."""
        values = _u64(values)
        bucket = values >> np.uint64(self.bits)
        last = np.uint64(self.zeros_in_all() - 1)
        inside = bucket <= last
        bucket = np.minimum(bucket, last).astype(np.int64)
        ends = self._zero(bucket) - bucket
        starts = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) - bucket + 1, 0)
        low, high = np.where(inside, starts, self.n), np.where(inside, ends, self.n)
        if start is not None:
            low, high = np.clip(low, start, end), np.clip(high, start, end)
        wanted = values & np.uint64((1 << self.bits) - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = unpack(self.low, self.bits, middle) < wanted[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low

    def zeros_in_all(self) -> int:
        """One zero ends each bucket; the bits after the last number's bucket are zeros as well."""
        return 64 * len(self.high) - self.n

    def find(self, values, start=None, end=None) -> np.ndarray:
        """Place of each value, or -1; numbers are distinct."""
        values = _u64(values)
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        place = self.successor(values, start, end)
        there = place < (self.n if end is None else end)
        at = np.where(there, place, 0)
        # a place inside the bucket has the value's top bits; a place after it has others
        same = there & (self.get(at) == values)
        return np.where(same, place, -1)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.uint64), self.low, self.high, self.zeros]

    @classmethod
    def view(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])


class Level:
    """One level of a trie: contexts, pointers to the range of each one's successors, and a code for each successor.

    Successors are stored relative to their context, (its rank << 32) + successor, so the whole level rises. A level is
    one flat buffer of 64-bit words; `Level(buffer)` views it in place, whether it lies in memory or in a mapped file.
    """

    def __init__(self, buffer):
        words = np.frombuffer(buffer, np.uint64)
        n, at, arrays = int(words[0]), 1 + int(words[0]), []
        for size in words[1 : 1 + n].astype(np.int64).tolist():
            arrays.append(words[at : at + size])
            at += size
        self.contexts, self.pointers, self.successors = (EliasFano.view(arrays[4 * i : 4 * i + 4]) for i in range(3))
        self.codes, self.weights = arrays[12].view(np.uint8), arrays[13].view(np.uint8)

    @staticmethod
    def build(contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> bytes:
        """Sorted distinct contexts, where their successors (32 bits, sorted in each context) start, a code (8 bits) for
        each successor and one for each context."""
        sizes = np.diff(np.r_[starts, len(successors)])
        relative = (np.repeat(np.arange(len(contexts), dtype=np.uint64), sizes) << np.uint64(32)) | _u64(successors)
        arrays = []
        for values in (contexts, np.r_[starts, len(successors)], relative):
            arrays += EliasFano.of(values).arrays()
        for code in (codes, weights):
            arrays.append(np.r_[code, np.zeros(-len(code) % 8, np.uint8)].astype(np.uint8).view(np.uint64))
        return np.concatenate([_u64([len(arrays), *map(len, arrays)]), *arrays]).tobytes()

    def find(self, contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight by context, code by successor) of `contexts`, each with `sizes` of the successors; 0 where there is none."""
        if not len(self.codes) or not len(contexts):
            return np.zeros(len(contexts), np.uint8), np.zeros(len(successors), np.uint8)
        rank = self.contexts.find(contexts)
        known = rank >= 0
        weights = np.where(known, self.weights[np.maximum(rank, 0)], 0).astype(np.uint8)
        start, end = (self.pointers.get(np.maximum(rank, 0) + i).astype(np.int64) for i in (0, 1))
        asked = np.flatnonzero(np.repeat(known, sizes))
        rank, start, end = (np.repeat(a, sizes)[asked] for a in (rank, start, end))
        place = self.successors.find((_u64(rank) << np.uint64(32)) | _u64(successors[asked]), start, end)
        codes = np.zeros(len(successors), np.uint8)
        codes[asked] = np.where(place >= 0, self.codes[np.maximum(place, 0)], 0)
        return weights, codes
