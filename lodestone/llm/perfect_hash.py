"""Minimal perfect hashing of distinct 64-bit keys.

A key is placed on the first level where no other remaining key meets its
position; the positions taken are bits, and a key's hash is the number of bits
before its own. ``n`` keys get the hashes 0 to ``n - 1``, at about four bits a key.
A key that was not built in gets -1 or the hash of another: whoever looks up
compares the key stored under the hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lodestone.llm.words import GOLDEN, mix

SPARE = 2  # positions a remaining key
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + GOLDEN * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """``sizes`` of the levels, each a multiple of 8, and their bits one level after another."""

    sizes: np.ndarray
    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, bits: np.ndarray) -> PerfectHash:
        return cls(sizes, bits, np.concatenate([[0], np.cumsum(_ONES[bits])[:-1]]) if len(bits) else np.zeros(0, np.int64))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` are distinct ``uint64``; equal ones would never part."""
        left, sizes, bits = keys, [], []
        while len(left):
            size = -(-SPARE * len(left) // 8) * 8
            at = _positions(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone))
            left = left[~alone[at]]
        return cls.of(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, np.uint8))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, head = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = _positions(keys[left], level, size) + head
            byte, shift = at >> 3, 7 - (at & 7)
            row = self.bits[byte]
            hit = (row >> shift.astype(np.uint8)) & 1 == 1
            rank = self.before[byte] + _ONES[row >> (shift + 1).astype(np.uint8)]
            out[left[hit]] = rank[hit]
            left, head = left[~hit], head + size
        return out
