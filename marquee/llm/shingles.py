"""Sets of word-shingle hashes, computed for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from marquee.llm.common import SHINGLE

#: Bytes of text hashed at a time: bounds the memory of a task, also for a single huge text.
PIECE = 1 << 16

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TURNS = np.random.default_rng(21).integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | _U(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    def __init__(self):
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            ones = np.full(n, _BASE, dtype=np.uint64), np.full(n, _INVERSE, dtype=np.uint64)
            ones[0][0] = ones[1][0] = 1
            self.powers, self.inverses = (np.multiply.accumulate(x) for x in ones)

    def _words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of the words of UTF-8 bytes; no word crosses the positions in `cuts`."""
        self._grow(len(data) + 1)
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data] * self.powers[: len(data)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64)), starts

    def _long_text(self, data: np.ndarray) -> np.ndarray:
        hashes, at = [], 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
            hashes.append(self._words(data[at:end], np.zeros(0, dtype=np.int64))[0])
            at = end
        return np.concatenate(hashes)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text: of all its words if fewer than five, none without words."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        if not n:
            return
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
        i = 0
        while i < n:
            j = i + 1
            while j < n and offsets[j + 1] - offsets[i] <= PIECE:
                j += 1
            part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if j == i + 1 and len(part) > PIECE:
                words, of = self._long_text(part), None
                yield self._set(words, self._runs(words))
            else:
                words, starts = self._words(part, bounds)
                of = np.searchsorted(starts, bounds)
                runs = self._runs(words)
                for a, b in zip(of[:-1], of[1:]):
                    yield self._set(words[a:b], runs[a : max(a, b - SHINGLE + 1)])
            i = j

    @staticmethod
    def _runs(words: np.ndarray) -> np.ndarray:
        if len(words) < SHINGLE:
            return words[:0]
        n = len(words) - SHINGLE + 1
        total = words[:n] * _TURNS[0]
        for k in range(1, SHINGLE):
            total = total + words[k : k + n] * _TURNS[k]
        return _mixed(total)

    @staticmethod
    def _set(words: np.ndarray, runs: np.ndarray) -> np.ndarray:
        if len(words) >= SHINGLE:
            return np.unique(runs)
        if not len(words):
            return words
        total = _U(len(words))
        with np.errstate(over="ignore"):
            for k in range(len(words)):
                total = total + words[k] * _TURNS[k]
        return _mixed(np.array([total], dtype=np.uint64))
