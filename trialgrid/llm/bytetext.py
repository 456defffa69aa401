"""Whole documents as one byte array: tokens, hashes and shingles in numpy.

Texts stay UTF-8 bytes. Every character outside ASCII has bytes of 0x80 and
above only, so character classes that treat all of those alike can be decided
byte by byte. All hashes are 64-bit and depend on content alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(71).integers(1, 1 << 63, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of letters and digits: 0-9, a-z (after lower-casing) and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words between blanks: anything but 0x20 and 0x09-0x0D.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole documents of about ``most`` bytes.

    Yields (first row, bytes, bounds); document k of the run is
    ``bytes[bounds[k]:bounds[k + 1]]``. A null counts as an empty text, and a
    document longer than ``most`` has a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        end = max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1)
        end = min(end, len(column))
        yield k, data[at[k] : at[end]], at[k : end + 1] - at[k]
        k = end


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE)
        )


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 21, 1 << int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which :func:`span_hash` takes any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each ``bytes[start:end]``; equal spans have equal hashes."""
    value = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * 0x51ED2701 + 1))


def tokens(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which ``inside`` holds, never across documents.

    Returns (starts, ends, token bounds): the tokens of document k are numbered
    ``token_bounds[k]`` up to ``token_bounds[k + 1]``.
    """
    held = inside[data]
    if not held.any():
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1] | edge[1:-1]
    last[:-1] &= ~held[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def shingles(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each document, as hashes in ascending order.

    A document of fewer words has one shingle of all its words, and none if it
    has no words. Returns (hashes, bounds by document).
    """
    low = LOWER[data]
    starts, ends, at = tokens(low, bounds, ALNUM)
    word = span_hash(prefix_sums(low), starts, ends)
    n = len(word)
    out: list[np.ndarray] = []
    if n >= words:
        rolled = np.zeros(n - words + 1, np.uint64)
        for j in range(words):
            rolled = rolled * np.uint64(0x2545F4914F6CDD1D) + word[j : j + n - words + 1]
        rolled = mix(rolled)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            value = np.full(1, hi - lo, np.uint64)
            for x in word[lo:hi]:
                value = value * np.uint64(0x2545F4914F6CDD1D) + x
            out.append(mix(value))
        else:
            out.append(np.zeros(0, np.uint64))
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
