"""Minimal perfect hashing of 128-bit keys, in numpy.

A key goes through levels of bit arrays: at each level a hash of its own gives it
a place, and keys that have a place to themselves stay there while the others go
on to the next level (Limasset et al., "Fast and scalable minimal perfect hashing
for massive key sets", 2017). A key's number is the count of bits set before its
own, so n keys have the numbers 0 to n-1 and the structure needs about four bits
a key. A key that is not of the set gets any number or none; who must know keeps
the key's fingerprint in an array at that number.
"""

from __future__ import annotations

import numpy as np

from tracewell.llm.common import mix64

#: Places a level has for each key that reaches it.
GAMMA = 2.0
_STEP = 0x9E3779B97F4A7C15


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix64(hi ^ mix64(lo + np.uint64((level + 1) * _STEP % (1 << 64))))
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """sizes: places of each level; words: all levels' bits, each level from a new word on."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.first = np.concatenate([[0], np.cumsum([-(-s // 64) for s in sizes])]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1])

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        """From distinct keys, each given by two 64-bit halves."""
        sizes, words = [], [np.zeros(0, np.uint64)]
        while len(hi):
            size = max(64, int(GAMMA * len(hi)))
            at = _place(hi, lo, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, bool)
            bits[:size] = alone
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = ~alone[at]
            hi, lo = hi[rest], lo[rest]
        return cls(sizes, np.concatenate(words))

    def number(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The numbers of keys; -1 for some of those that are not of the set."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(hi[left], lo[left], level, size)
            word, bit = self.first[level] + (at >> 6), (at & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[word[hit]] + below
            left = left[~hit]
        return out
