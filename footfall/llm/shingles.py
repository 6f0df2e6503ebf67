"""Sets of word shingles as 64-bit hashes, computed for many texts at a time."""

from __future__ import annotations

import numpy as np

# Fixed odd multipliers; any would do.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


# A random value for each byte, so that sums of scaled bytes behave as hashes.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    powers = np.full(count, base, dtype=np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many each text has.

    Words are runs of bytes other than blanks; A-Z count as a-z. A word's hash is its
    stretch of a running sum of scaled bytes, scaled back to where it begins.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    word = np.concatenate(([False], ~_BLANK[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _powers(_BASE, len(data)), out=sums[1:], dtype=np.uint64)
    back = _powers(_INVERSE, len(data) + 1)
    hashes = mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(begin, stops, side="left"), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer words than ``size`` has its whole sequence as one shingle, one
    without words has none.
    """
    if not texts:
        return []
    hashes, counts = word_hashes(texts)
    scale = _powers(_BASE, size + 1)
    full = np.zeros(max(len(hashes) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        full += hashes[k : k + len(full)] * scale[k + 1]
    full = mixed(full)
    sets, start = [], 0
    for count in counts.tolist():
        if count >= size:
            sets.append(np.unique(full[start : start + count - size + 1]))
        elif count:
            part = hashes[start : start + count]
            whole = (part * scale[1 : count + 1]).sum(dtype=np.uint64) + np.uint64(count)
            sets.append(mixed(np.array([whole], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        start += count
    return sets
