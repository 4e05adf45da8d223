"""Vectorised 64-bit hashes of the words and substrings of byte arrays."""

from __future__ import annotations

import functools

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end], the same for equal bytes wherever they stand."""
    size = 1 << max(12, int(len(data)).bit_length())
    up, down = powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside \\x20 and \\x09-\\x0D."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def parts(offsets: np.ndarray, limit: int):
    """(first, last) ranges of the documents between offsets, of about limit bytes each; a longer document is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last
