"""Words of many documents at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

#: A word is a run of bytes other than the blank and the five control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random number for each byte value, so that sums of powers do not follow the alphabet.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the number of words before it (n + 1 numbers)."""
    full = ~SPACE[data]
    if not full.any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = full.copy()
    start[1:] &= ~full[:-1] | edge[1:-1]
    end = full.copy()
    end[:-1] &= ~full[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, at)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal spans have equal hashes. `data` is not changed."""
    out = np.full(len(start), 0x12345, np.uint64)
    size = end - start
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    h = out[order]
    many = len(order)
    longest = int(n[0]) if many else 0
    for j in range(longest):
        while many and n[many - 1] <= j:
            many = int(np.searchsorted(-n, -j, side="left"))
        if not many:
            break
        h[:many] = h[:many] * BASE + BYTES[data[s[:many] + j]]
        if j >= 64 and many < 8:  # few giant words: the rest byte by byte in blocks
            break
    else:
        longest = 0
    if longest and many:
        for i in range(many):
            if n[i] > j + 1:
                h[i] = _tail(h[i], data[s[i] + j + 1 : s[i] + n[i]])
    out[order] = h
    return mixed(out ^ size.astype(np.uint64))


def _tail(h: np.uint64, rest: np.ndarray) -> np.uint64:
    """The same polynomial continued over a long run, in blocks."""
    for i in range(0, len(rest), 4096):
        block = BYTES[rest[i : i + 4096]]
        powers = np.ones(len(block), np.uint64)
        if len(block) > 1:
            powers[1:] = np.cumprod(np.full(len(block) - 1, BASE, np.uint64), dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = h * (powers[-1] * BASE) + (block * powers[::-1]).sum(dtype=np.uint64)
    return h
