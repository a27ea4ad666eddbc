"""A minimal perfect hash over 128-bit keys, built level by level, with numpy.

Each level is a bit array of twice the keys that are left. A key that alone falls on a bit owns it;
the others go on to the next level. A key's number is the rank of its bit among all set bits, so n keys
get the numbers 0 to n-1. A key outside the set gets some number or -1; callers store fingerprints to tell.
"""

from __future__ import annotations

import struct

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
MAX_LEVELS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers (the finishing step of a splitmix generator)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        step = _STEP * np.uint64(level + 1)
        return (mix(high + step) ^ mix(low - step)) % np.uint64(size)


def fingerprints(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """32 bits of each key, independent of the slots."""
    with np.errstate(over="ignore"):
        return (mix(high ^ (low * _STEP)) >> np.uint64(32)).astype(np.uint32)


class MinimalPerfectHash:
    """levels: bit arrays as 64-bit words."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(w).astype(np.int64) for w in levels]
        self.ranks, before = [], 0
        for c in counts:
            self.ranks.append(before + np.concatenate([[0], np.cumsum(c)[:-1]]) if len(c) else np.zeros(0, np.int64))
            before += int(c.sum())
        self.n = before

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> MinimalPerfectHash:
        """high, low: the halves of distinct keys. Repeated keys raise ValueError."""
        levels = []
        for level in range(MAX_LEVELS):
            if not len(high):
                return cls(levels)
            words = 2 * len(high) // 64 + 1
            slot = _slots(high, low, level, words * 64)
            alone = np.bincount(slot.astype(np.int64), minlength=words * 64)[slot.astype(np.int64)] == 1
            own = slot[alone]
            bits = np.zeros(words, np.uint64)
            np.bitwise_or.at(bits, (own >> np.uint64(6)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
            levels.append(bits)
            high, low = high[~alone], low[~alone]
        raise ValueError("keys repeat")

    def lookup(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for a key that is surely not in the set."""
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            slot = _slots(high[left], low[left], level, len(bits) * 64)
            word, bit = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = ranks[word[hit]] + np.bitwise_count(below[hit])
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<Q", len(w)) for w in self.levels) + b"".join(w.astype("<u8").tobytes() for w in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        (n,) = struct.unpack_from("<I", data)
        sizes, at, levels = struct.unpack_from(f"<{n}Q", data, 4), 4 + 8 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at).astype(np.uint64))
            at += 8 * size
        return cls(levels)
