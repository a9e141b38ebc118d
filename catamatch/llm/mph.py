"""Minimal perfect hashing of 128-bit keys in numpy.

Level by level every key is thrown into a bit array of about twice the keys; keys alone in
their place stay there, the others go on to the next level.  A key's slot is the number of set
bits before its own, so n keys fill the slots 0..n-1; the structure takes about 4 bits a key.
It knows nothing of keys outside the set: callers compare what the slot holds.
"""

from __future__ import annotations

import numpy as np

from catamatch.llm.words import mix

LEVELS = 64


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(mix(hi + np.uint64(level)) ^ lo) % np.uint64(size)).astype(np.int64)


def build(hi: np.ndarray, lo: np.ndarray) -> bytes:
    """Structure for distinct keys given as two uint64 arrays."""
    sizes, bits = [], []
    while len(hi):
        if len(sizes) == LEVELS:
            raise ValueError("keys are not distinct")
        size = (2 * len(hi) + 63) // 64 * 64
        at = _place(hi, lo, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        rest = ~alone[at]
        hi, lo = hi[rest], lo[rest]
    head = np.array([len(sizes), *sizes], np.int64).tobytes()
    return head + b"".join(b.tobytes() for b in bits)


def slots(blob: bytes, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Slot of each key; for a key outside the set any slot, or -1."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    words = np.frombuffer(blob, np.uint64, offset=8 * (n + 1))
    before = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bitwise_count(words), out=before[1:])
    out = np.full(len(hi), -1, np.int64)
    todo, start = np.arange(len(hi)), 0
    for level, size in enumerate(sizes):
        if not len(todo):
            break
        at = _place(hi[todo], lo[todo], level, int(size)) + start
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit & np.uint64(1)).astype(bool)
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[todo[hit]] = (before[at >> 6] + below)[hit]
        todo = todo[~hit]
        start += int(size)
    return out
