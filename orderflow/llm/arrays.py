"""Word hashes of many texts at once, for the operators that work on runs of words."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER_CODES = _CODES[_LOWER]
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    """Powers of the base (or of its inverse) modulo 2**64, kept for the longest chunk so far."""
    name = "inverse" if inverse else "plain"
    if len(_powers.get(name, ())) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _BASE_INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def words(body: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts (runs without the six ASCII white-space characters), and the number of words of each text.
    ``at`` has the texts' offsets in ``body``. With ``lower``, A-Z count as a-z."""
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    word = ~_SPACE[body]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    through = np.cumsum((_LOWER_CODES if lower else _CODES)[body] * _power(n, False))
    before = np.where(first > 0, through[first - 1], np.uint64(0))
    hashes = mix((through[last] - before) * _power(n, True)[first] + (last - first + 1).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(first, at))


def runs(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``k`` words of each text, in order, and their number a text. A text with fewer words has one run of all
    its words; a text without words has none."""
    found = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.cumsum(counts) - counts
    total = int(found.sum())
    starts = np.arange(total) - np.repeat(np.cumsum(found) - found - begin, found)
    length = np.repeat(np.minimum(counts, k), found).astype(np.uint64)
    out = mix(length)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    for i in range(k):
        factor = np.uint64((2 * i + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
        out += np.where(length > i, padded[starts + i] * factor, np.uint64(0))
    return mix(out), found

