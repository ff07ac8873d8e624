"""Words and lines of many texts at once, as numpy arrays over their bytes.

Hashes are sums of random byte values times powers of an odd base, modulo 2**64, then mixed: a word's hash costs a few
vectorised passes over the bytes, without any Python object for a word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about SLICE bytes; a longer text is a slice of its own.
SLICE = 2_000_000
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.RandomState(20240229)
BYTE = _RANDOM.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
WORD_BYTE = np.where(BLANK, np.uint64(0), BYTE)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEPS = _RANDOM.randint(1, 1 << 62, 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(size, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@functools.lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * SLICE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; kept for slices of the usual size, made anew for a longer text."""
    a, b = _kept_powers() if n <= 2 * SLICE else _powers(n)
    return a[:n], b[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Slice:
    """Texts of rows first to last: data holds their bytes, text i has bytes bounds[i] to bounds[i + 1]."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


def slices(texts: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """The texts (null: empty) in slices, letters A-Z lower-cased on demand."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        own = data[offsets[first] : offsets[last]]
        if lower:
            own = own + (((own >= 65) & (own <= 90)).astype(np.uint8) << 5)
        yield Slice(first, last, own, offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a slice: starts and ends of bytes, hash of each, text of each; words of text i are cuts[i] to cuts[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    cuts: np.ndarray


def words(part: Slice) -> Words:
    data, n = part.data, len(part.data)
    solid = ~BLANK[data]
    begins, closes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edges = part.bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = solid[edges]
    closes[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    if len(starts):
        up, down = powers(n)
        hashes = mixed(np.add.reduceat(WORD_BYTE[data] * up, starts) * down[starts])
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(starts, ends, hashes, np.searchsorted(starts, part.bounds))


def windows(hashes: np.ndarray, cuts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that lie inside one text, and the word at which each begins."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.ones(total - n + 1, bool)
    for k in range(1, n):
        crossed = cuts[1:-1] - k
        inside[crossed[(crossed >= 0) & (crossed < len(inside))]] = False
    out = hashes[: total - n + 1] * STEPS[0]
    for k in range(1, n):
        out += hashes[k : total - n + 1 + k] * STEPS[k]
    at = np.flatnonzero(inside)
    return mixed(out[at]), at
