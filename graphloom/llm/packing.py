"""Sum-of-squares online packing of token streams into windows.

An array counts the partly filled windows of every fill level. A document's last, shorter piece goes to the window
whose change keeps the sum of the squared counts smallest; longer documents first fill windows of their own. A level
holds at most AT_LEVEL windows, always: a piece that would make one more fills what is left of the fullest window
instead, and its rest is placed in turn. So memory is bounded by the levels, whatever the texts.

Every partition packs on its own, so no key gathers rows, and a lost task packs the same rows again. What windows a
partition leaves open goes on: the pieces of all partitions' open windows are placed once more by the same rule, in as
few tasks as there are ROUND_IDS ids among them. So squares fill most windows even where partitions are small. Only at
the end of that round windows are closed by cutting: the emptiest one is taken apart, again and again, and its pieces
close the fullest ones, cut to what these have left. The pieces of the last one are cut at powers of two, which need no
padding.

Defined results:
null and empty texts are the end id alone; added tokens of the vocabulary's JSON file have their own ids wherever a
text holds them, as in the tokenizers library; documents of any length are cut; repeated rows are packed as documents of
their own; an empty table gives no sequences.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .bpe import small_slices
from .hashing import give_back

END_ID = 1
#: Windows of one fill level, at most: with 2048 levels their ids take some 130 MB at the very worst.
AT_LEVEL = 16
#: Ids of open windows for each task of the second round; it bounds the number of windows closed by cutting.
ROUND_IDS = 1 << 24
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, placed boolean"

#: row, start, ids, doc_tokens
Piece = tuple[int, int, np.ndarray, int]


class SquareSums:
    """Windows of ``size`` ids; finished ones go to ``full`` as lists of pieces."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.full: list[list[Piece]] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        whole, total = len(ids) // self.size, len(ids)
        for k in range(whole):
            self.full.append([(doc, k * self.size, ids[k * self.size : (k + 1) * self.size], total)])
        if total % self.size:
            self.place((doc, whole * self.size, ids[whole * self.size :], total))

    def place(self, piece: Piece) -> None:
        c, never = self.counts, np.int64(1) << 40
        rest: Piece | None = piece
        while rest:
            n = len(rest[2])
            # moving a window from level h to h + n changes the sum by 1 - 2 c[h] and, unless full there, by 1 + 2 c[h + n]
            change = np.where(c[n:] < AT_LEVEL, 2 * c[n:] + 1, never)
            change[-1] = 0
            change[1:] += np.where(c[1 : len(c) - n] > 0, 1 - 2 * c[1 : len(c) - n], never)
            # the fullest of equal levels
            level = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[level] >= never // 2:
                rest = self._fill(rest)
                continue
            window = self._take(level) if level else []
            window.append(rest)
            self._put(level + n, window)
            return

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        return self.open[level].pop()

    def _put(self, level: int, window: list[Piece]) -> None:
        if level == self.size:
            self.full.append(window)
        else:
            self.open[level].append(window)
            self.counts[level] += 1

    def _fill(self, piece: Piece) -> Piece | None:
        """Put the piece, or as much of it as there is room, into the fullest window; what is left of it."""
        doc, start, ids, total = piece
        level = int(np.flatnonzero(self.counts)[-1])
        room = min(self.size - level, len(ids))
        window = self._take(level)
        window.append((doc, start, ids[:room], total))
        self._put(level + room, window)
        return (doc, start + room, ids[room:], total) if room < len(ids) else None

    def leave(self) -> list[Piece]:
        """The pieces of all open windows, which are open no more."""
        out = [piece for level in self.open for window in level for piece in window]
        self.counts[:] = 0
        self.open = [[] for _ in self.open]
        return out

    def close(self) -> None:
        """Close all windows, the emptiest ones' pieces going into the fullest ones."""
        left: list[Piece] = []
        while self.counts.any():
            for piece in self._take(int(np.flatnonzero(self.counts)[0])):
                rest: Piece | None = piece
                while rest and self.counts.any():
                    rest = self._fill(rest)
                if rest:
                    left.append(rest)
        # less than a window is left: its ids at powers of two
        total = sum(len(p[2]) for p in left)
        at, cut = 0, 0
        for bit in reversed(range(total.bit_length())):
            window, room = [], total & (1 << bit)
            while room:
                doc, start, ids, tokens = left[at]
                take = min(room, len(ids) - cut)
                window.append((doc, start + cut, ids[cut : cut + take], tokens))
                room, cut = room - take, cut + take
                if cut == len(ids):
                    at, cut = at + 1, 0
            if window:
                self.full.append(window)

    def drain(self) -> list[list[Piece]]:
        out, self.full = self.full, []
        return out


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the JSON file beside the ranks; none without that file."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    """One tokenizer for each worker; its encode_ordinary reads added tokens as text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added_tokens(path))


def _rows(windows: list[list[Piece]], first: int, placed: bool, kind: pa.DataType) -> pa.RecordBatch:
    """Pieces of finished windows, numbered from ``first`` on; empty ``ids``, as nothing more is done with them."""
    out: list[tuple] = []
    for k, window in enumerate(windows):
        offset = 0
        for doc, start, ids, total in window:
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first + k, offset, placed, None))
            offset += len(ids)
    return _batch(out, kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * 6, pa.bool_(), pa.binary()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "placed", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names)


def pack_documents(docs: DataFrame, path: str, pattern: str, size: int = 2048, round_ids: int = ROUND_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, placed (false where the
    sequence was closed by cutting).

    ``path`` holds the ranks of the byte-level vocabulary; a document ends with END_ID. The first round's pieces are
    written, with the ids of those alone that the second round places again, so texts are encoded once.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        added = sorted(own.special_tokens_set)
        windows, next_id = SquareSums(size), TaskContext.get().partitionId() << 40
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            keys = iter(batch.column(0).to_pylist())
            for texts in small_slices(batch.column(1)):
                for text in texts:
                    ids = own.encode(text, allowed_special="all") if any(t in text for t in added) else own.encode_ordinary(text)
                    ids.append(END_ID)
                    windows.add(next(keys), np.frombuffer(array("I", ids), np.uint32).astype("<u4", copy=False))
            full = windows.drain()
            yield _rows(full, next_id, True, kind)
            next_id += len(full)
        left = windows.leave()
        for k in range(0, len(left), 1024):
            yield _batch([(doc, start, len(ids), None, total, None, None, None, ids.tobytes()) for doc, start, ids, total in left[k : k + 1024]], kind)
        give_back()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers of this round lie above those of the first
        windows, next_id = SquareSums(size), (1 << 62) + (TaskContext.get().partitionId() << 40)
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, start, total, ids in zip(*(column.to_pylist() for column in batch.columns)):
                windows.place((doc, start, np.frombuffer(ids, "<u4"), total))
            full = windows.drain()
            yield _rows(full, next_id, True, kind).drop_columns("ids")
            next_id += len(full)
        windows.close()
        yield _rows(windows.drain(), next_id, False, kind).drop_columns("ids")
        give_back()

    schema = SCHEMA.format(docs.schema["doc_id"].dataType.simpleString())
    pieces = written(docs.select("doc_id", "text").mapInArrow(packed, schema + ", ids binary"), "pieces")
    left = pieces.where("sequence_id is null").select("doc_id", "start", "doc_tokens", "ids")
    tasks = math.ceil((pieces.where("sequence_id is null").agg(F.sum("length")).first()[0] or 1) / round_ids)
    return pieces.where("sequence_id is not null").drop("ids").unionByName(left.coalesce(tasks).mapInArrow(again, schema))
