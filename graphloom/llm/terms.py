"""Where the words of Arrow text columns lie, and exact codes for them, whole blocks of rows at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .hashing import SPACE

#: Separators: every ASCII byte that is no letter.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] = _SAME[97:123]


class TextBlock:
    """The words of some rows, as byte ranges ``starts`` to ``ends`` of ``bytes``; ``rows`` are the rows' offsets into
    them (one more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        begin, end = int(offsets[0]), int(offsets[-1])
        self.bytes, self.offsets = data[begin:end], offsets - begin
        self.inside = ~separators[self.bytes]
        cut = np.zeros(end - begin + 1, bool)  # a word ends where its row does
        cut[self.offsets] = True
        edge = np.zeros(end - begin + 1, bool)
        edge[1:] = self.inside
        self.starts = np.flatnonzero(self.inside & (~edge[:-1] | cut[:-1]))
        edge[:-1], edge[-1] = self.inside, False
        self.ends = np.flatnonzero(self.inside & (~edge[1:] | cut[1:])) + 1
        self.rows = np.searchsorted(self.starts, self.offsets)

    def codes(self, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal for equal words alone, and the words by number; ``lower`` folds A to Z."""
        held = (_LOWER if lower else _SAME)[self.bytes[self.inside]]
        offsets = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_string(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        return words.indices.to_numpy().astype(np.int64), words.dictionary

    def row_of_words(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def joined(self, kept: np.ndarray) -> pa.Array:
        """The kept words of each row, joined by one space."""
        moved = np.zeros(len(self.bytes) + 1, np.int8)
        np.add.at(moved, self.starts[kept], 1)
        np.add.at(moved, self.ends[kept], -1)
        out, at = np.cumsum(moved[:-1], dtype=np.int8).astype(bool), np.flatnonzero(kept)
        inner = np.diff(np.searchsorted(self.rows, at, "right")) == 0  # another kept word of the row follows
        spaces = self.ends[at[:-1][inner]]
        data = self.bytes.copy()
        data[spaces], out[spaces] = 32, True
        sizes = np.zeros(len(out) + 1, np.int64)
        np.cumsum(out, out=sizes[1:])
        return pa.Array.from_buffers(pa.large_string(), len(self.rows) - 1, [None, pa.py_buffer(sizes[self.offsets]), pa.py_buffer(data[out])])
