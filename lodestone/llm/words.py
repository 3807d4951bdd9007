"""Word and shingle hashes of many whole texts at once.

Bytes go through a table of random 64-bit values, a word is their sum over
powers of an odd base, a shingle is a mixed linear form of its words' hashes.
All arithmetic wraps at 64 bits; two different shingles of one text agree with
a chance of about 2**-64, so sets of these hashes stand for sets of shingles.
"""

from __future__ import annotations

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed))


_BYTES = stream(11, 256)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_FORM = stream(13, 64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of the base, grown to the longest word met."""

    values = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.values) < n:
            grown = np.full(max(n, 2 * len(cls.values)), _BASE, dtype=np.uint64)
            grown[0] = 1
            cls.values = np.multiply.accumulate(grown)
        return cls.values


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and the first word of each text (one entry more than texts)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1]
    heads = heads[heads < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:]
    tails = tails[tails > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every (non-empty, ascending, disjoint) span of ``data``."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    heads = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(heads, lengths)
    values = _BYTES[data[within + np.repeat(starts, lengths)]]
    values *= Powers.upto(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))


def linear(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words (their number is ``len(words) - n + 1``, or none)."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = words[:k] * _FORM[0]
    for j in range(1, n):
        out += words[j : j + k] * _FORM[j]
    return mix(out + np.uint64(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each text its set of distinct ``n``-word shingles as sorted hashes.

    A-Z count as a-z. A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = hash_spans(data, starts, ends)
    runs = linear(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        else:
            out.append(linear(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
