"""Minimal perfect hashes over distinct digests, built and looked up with numpy.

A level is a bit array of about twice its keys: a key whose place no other key takes sets that bit and is done, the others
go on to the next level. A key's slot is the number of bits set before its own, over all levels, so that n keys have the
slots 0 to n - 1 and the table costs about four bits a key. A key that was not stored may also be given a slot: whoever
looks up compares the key kept at that slot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gridspark.llm.text import mix

_STEP = 0x9E3779B97F4A7C15
#: Seeds tried until all digests differ in 64 bits.
_SEEDS = 16


def _times(n: int) -> np.uint64:
    return np.uint64(n * _STEP % (1 << 64))


def fold(digests: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each row of an array of 64-bit lanes."""
    h = np.full(len(digests), _times(seed + 1), dtype=np.uint64)
    for lane in digests.T:
        h = mix(h ^ lane) + _times(1)
    return h


def distinct(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the position of one occurrence of each."""
    order = np.lexsort(digests.T)
    held = digests[order]
    new = np.ones(len(held), dtype=bool)
    new[1:] = (held[1:] != held[:-1]).any(axis=1)
    return held[new], order[new]


def _places(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + _times(level)) % np.uint64(size)).astype(np.int64)


@dataclass
class _Level:
    bits: np.ndarray
    before: np.ndarray


@dataclass
class PerfectHash:
    seed: int
    levels: list[_Level]

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        """``digests`` holds one key a row, each once."""
        for seed in range(_SEEDS):
            left = fold(digests, seed)
            if len(np.unique(left)) == len(left):
                break
        else:
            raise ValueError("a key is given twice")
        levels: list[_Level] = []
        done = 0
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            places = _places(left, len(levels), size)
            alone = np.bincount(places, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            before = np.zeros(len(bits), dtype=np.int64)
            np.cumsum(np.bitwise_count(bits[:-1]), out=before[1:])
            levels.append(_Level(bits, before + done))
            done += int(alone.sum())
            left = left[~alone[places]]
        return cls(seed, levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each row, -1 for some of the rows that are not stored."""
        out = np.full(len(digests), -1, dtype=np.int64)
        h, at = fold(digests, self.seed), np.arange(len(digests))
        for k, level in enumerate(self.levels):
            if not len(at):
                break
            places = _places(h, k, 64 * len(level.bits))
            words = level.bits[places >> 6]
            bit = (places & 63).astype(np.uint64)
            hit = (words >> bit) & np.uint64(1) == 1
            below = words[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[at[hit]] = level.before[places[hit] >> 6] + np.bitwise_count(below)
            h, at = h[~hit], at[~hit]
        return out


class SlotTable:
    """Slots of the different rows of ``digests``; ``digests[first[slot]]`` is the key kept at a slot."""

    def __init__(self, digests: np.ndarray):
        keys, at = distinct(digests)
        self.hash = PerfectHash.of(keys)
        where = self.hash.slots(keys)
        self.n = len(keys)
        self.keys, self.first = np.empty_like(keys), np.empty(len(keys), dtype=np.int64)
        self.keys[where], self.first[where] = keys, at

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Verified slot of each row, -1 for a row that is not stored."""
        found = self.hash.slots(digests)
        if self.n:
            found[(self.keys[found] != digests).any(axis=1)] = -1
        return found
