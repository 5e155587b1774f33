"""Words of Arrow text columns as 64-bit hashes, whole blocks of rows at a time.

A block's UTF-8 bytes are read once with numpy: every byte value has a random 64-bit number, prefix sums of
``number * BASE ** position`` give the hash of any byte range, and words are runs between separator bytes.
No Python string is made.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Small enough for a block's arrays to stay in a core's cache, and for a worker to stay small.
BLOCK_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: Separators: the six ASCII white-space bytes.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators: every ASCII byte that is no letter and no digit.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, key: str, n: int) -> np.ndarray:
    held = _powers.get(key)
    if held is None or len(held) < n:
        held = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if n <= 4 * BLOCK_BYTES:
            _powers[key] = held
    return held[:n]


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def give_back() -> None:
    """Return what Arrow's pool and the C library hold but don't use; a worker that waits for its next task then stays
    small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


class Words:
    """The words of some rows: ``hashes``, and ``rows`` offsets into them (one more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False):
        begin, end = int(offsets[0]), int(offsets[-1])
        self.bytes, self.offsets = data[begin:end], offsets - begin
        size = end - begin
        inside = ~separators[self.bytes]
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(size, bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:size]))
        after = np.zeros(size, bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self._sums = np.zeros(size + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTES)[self.bytes] * _power(BASE, "base", size), out=self._sums[1:])
        self.hashes = self.range_hashes(self.starts, self.ends)
        self.rows = np.searchsorted(self.starts, self.offsets)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        unit = _power(INVERSE, "inverse", len(self.bytes) + 1)
        return mix((self._sums[ends] - self._sums[starts]) * unit[starts])

    def grams(self, n: int, gap: int = 0) -> np.ndarray:
        """Hashes of n words in a row (with ``gap`` words skipped after the first) from each word on; those that
        would cross a row's end are meaningless and left to ``gram_rows``."""
        h = self.hashes.copy()
        for k in range(1, n):
            at = k + gap
            h = h * BASE + np.uint64(n + 16 * gap)
            h[: max(0, len(h) - at)] += self.hashes[at:]
        return mix(h)

    def gram_counts(self, n: int, gap: int = 0) -> np.ndarray:
        """How many such runs of words each row has."""
        return np.maximum(np.diff(self.rows) - (n - 1 + (gap if n > 1 else 0)), 0)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """For each row its sorted distinct n-word hashes; rows of fewer words give their whole sequence as one; rows
    without words an empty array."""
    grams, out = words.grams(n), []
    for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist()):
        count = b - a
        if count >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif count:
            h = np.uint64(count)
            with np.errstate(over="ignore"):
                for x in words.hashes[a:b]:
                    h = h * BASE + x
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
