"""The random draws of Spark's trees, so that trees grown elsewhere draw the same rows and columns.

Spark's generator is a 64-bit xorshift whose seed is hashed (``XORShiftRandom``); seeds of nodes and partitions come from
Java's linear generator (``java.util.Random``). The draws of many seeds are made side by side in arrays.
"""

from __future__ import annotations

import math

import numpy as np

_M32, _M48, _M64 = (1 << 32) - 1, (1 << 48) - 1, (1 << 64) - 1
_LCG = 0x5DEECE66D
_UNIT = 2.0**-53
GAP_SHARE, GAP_LEAST = 0.4, 5e-11  # up to this share Spark draws how many rows to pass over


def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def _murmur(data: bytes, h: int) -> int:
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & _M32
        h ^= ((k << 15 | k >> 17) & _M32) * 0x1B873593 & _M32
        h = ((h << 13 | h >> 19) & _M32) * 5 + 0xE6546B64 & _M32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M32
    return h ^ h >> 16


def hashed_seed(seed: int) -> int:
    """The state that the generator starts from."""
    data = (seed & _M64).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


class XorShift:
    """One generator."""

    def __init__(self, seed: int):
        self.state = hashed_seed(seed)

    def bits(self, n: int) -> int:
        s = self.state
        s ^= s << 21 & _M64
        s ^= s >> 35
        self.state = s = s ^ (s << 4 & _M64)
        return s & ((1 << n) - 1)

    def integer(self) -> int:
        return _signed(self.bits(32), 32)

    def double(self) -> float:
        high = self.bits(26) << 27
        return (high + self.bits(27)) * _UNIT


class XorShifts:
    """A generator for each seed, all drawn from at once."""

    def __init__(self, seeds: list[int]):
        self.state = np.array([hashed_seed(s) for s in seeds], np.uint64)
        self.spare = np.empty_like(self.state)

    def _next(self) -> None:
        for shift, by in ((np.left_shift, 21), (np.right_shift, 35), (np.left_shift, 4)):
            shift(self.state, np.uint64(by), out=self.spare)
            self.state ^= self.spare

    def doubles(self) -> np.ndarray:
        self._next()
        high = (self.state & np.uint64((1 << 26) - 1)) << np.uint64(27)
        self._next()
        return (high + (self.state & np.uint64((1 << 27) - 1))).astype(np.float64) * _UNIT


def java_longs(seed: int, n: int) -> list[int]:
    """The first ``n`` long values of ``java.util.Random(seed)``."""
    out, s = [], (seed ^ _LCG) & _M48
    for _ in range(n):
        words = []
        for _ in range(2):
            s = (s * _LCG + 11) & _M48
            words.append(_signed(s >> 16, 32))
        out.append(_signed(((words[0] << 32) + words[1]) & _M64, 64))
    return out


class RowSample:
    """Which rows of a partition ``RDD.sample`` without replacement takes, in their order."""

    def __init__(self, share: float, seed: int, partition: int):
        self.share, self.rng = share, XorShift(java_longs(seed, partition + 1)[partition])
        self.skip = self._gap() if share <= GAP_SHARE else 0

    def _gap(self) -> int:
        return int(math.log(max(self.rng.double(), GAP_LEAST)) / math.log1p(-self.share))

    def take(self, n: int) -> np.ndarray:
        """For the next ``n`` rows whether they are taken."""
        out = np.zeros(n, bool)
        if self.share >= 1:
            out[:] = True
        elif self.share > GAP_SHARE:
            out[:] = [self.rng.double() <= self.share for _ in range(n)]
        else:
            at = self.skip
            while at < n:
                out[at] = True
                at += 1 + self._gap()
            self.skip = at - n
        return out


def drawn_rows(seeds: list[int], sizes: list[int], share: float) -> np.ndarray:
    """A line for each tree's seed: whether it takes a row; the rows lie in partitions of these sizes, one after the other."""
    out = np.ones((len(seeds), sum(sizes)), bool)
    if share >= 1:
        return out
    rng = XorShifts([seed + p + 1 for seed in seeds for p in range(len(sizes))])
    begins, lengths = np.cumsum([0, *sizes[:-1]]), np.array(sizes)
    for i in range(max(sizes)):
        taken = (rng.doubles() < share).reshape(len(seeds), -1)
        here = lengths > i
        out[:, begins[here] + i] = taken[:, here]
    return out


def drawn_columns(seeds: list[int], nodes: int, columns: int, kept: int) -> np.ndarray:
    """Of each tree's first ``nodes`` nodes in order, the columns drawn for them, in the order in which splits are compared."""
    rng = XorShifts([x for seed in seeds for x in java_longs(seed, nodes)])
    out = np.tile(np.arange(kept, dtype=np.int32), (len(seeds) * nodes, 1))
    for column in range(kept, columns):
        place = (rng.doubles() * (column + 1)).astype(np.int64)
        lines = np.flatnonzero(place < kept)
        out[lines, place[lines]] = column
    return out.reshape(len(seeds), nodes, kept)
