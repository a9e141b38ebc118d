"""Words and word shingles of whole texts as 64-bit hashes, in numpy.

Words are maximal runs of anything but blank and ``\\t..\\r``.  All of these are single bytes in
UTF-8, so the text is read as bytes.  A word's hash depends on its bytes alone, not on its place,
and long texts are hashed in pieces cut between words, so memory stays near the text's own size.
"""

from __future__ import annotations

import hashlib

import numpy as np

PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0xD6E8FEB86659FD93
_STEP = np.uint64(0x9FB21C651E98DF25)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, PIECE)
_BACK = _powers(pow(_BASE, -1, 1 << 64), PIECE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes, lower: bool = False) -> np.ndarray:
    """One uint64 per word of the UTF-8 text; ``lower`` folds A-Z first."""
    data = np.frombuffer(raw, np.uint8)
    if lower:
        data = _LOWER[data]
    starts, ends = word_bounds(data)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = int(np.searchsorted(ends, base + PIECE, "right"))
        if hi <= lo:  # a single word longer than a piece
            digest = hashlib.blake2b(data[base:ends[lo]].tobytes(), digest_size=8).digest()
            out[lo] = int.from_bytes(digest, "little")
            lo += 1
            continue
        part = data[base:ends[hi - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[:len(part)], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * _BACK[s]
        lo = hi
    return mix(out)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """A uint64 for each run of k consecutive words, by position."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * _STEP + words[j:j + n]
    return mix(acc + np.uint64(k))


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct k-word shingles, sorted; a shorter text is one shingle, an empty one none."""
    return np.unique(runs(words, min(k, len(words)))) if len(words) else np.empty(0, np.uint64)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A uint64 for each word span [start, end), equal for equal word sequences."""
    n = len(words)
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # starts ascend; spans are short against a piece
        base = int(starts[lo])
        hi = int(np.searchsorted(starts, base + PIECE // 2, "left"))
        part = words[base:min(n, base + PIECE)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POWERS[:len(part)], out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * _BACK[s] + (e - s).astype(np.uint64)
        lo = hi
    return mix(out)
