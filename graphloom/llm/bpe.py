"""Byte-level BPE with a segment tree over byte positions.

Texts are cut by the tokenizer's pattern. Pieces not seen before are merged many at a time: each piece has a segment
tree whose leaves are its byte positions and whose nodes hold the leftmost minimum of the ranks of live pairs. The root
names the next merge; a merge updates the leaves of the merged pair, its right part (now dead) and its live left
neighbour, each in a logarithmic number of steps. Rows of a numpy matrix are pieces of like length.

Defined results: null counts as empty, empty texts have no ids, pieces of any length are merged whole; the vocabulary's
path is a parameter. Repeated rows are encoded alike; empty tables give empty results.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

NONE = np.int64(1) << 62
#: Pieces that a worker keeps with their ids, and bytes of a matrix of trees, at most.
KEPT_PIECES, TREE_CELLS = 400_000, 1 << 21
#: Fewer pieces of like length than this are merged one by one.
FEW = 24


class Merges:
    """Ranks of byte strings (``bytes rank`` lines in base64), and the merges they imply."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = ((ranks.get(t[:k]), ranks.get(t[k:]), r) for t, r in ranks.items() for k in range(1, len(t)))
        table = np.array([(a << 32 | b, r) for a, b, r in pairs if a is not None and b is not None], np.int64)
        table = table[np.argsort(table[:, 0])]
        # open addressing over a power of two of at least four times as many slots
        self.mask = (1 << int(4 * len(table)).bit_length()) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, NONE, np.int64)
        left = table
        step = 0
        while len(left):
            at = (self._slot(left[:, 0]) + step) & self.mask
            free = self.keys[at] == -1
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            won = free & first
            self.keys[at[won]], self.values[at[won]] = left[won, 0], left[won, 1]
            left, step = left[~won], step + 1
        self.probes = step

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent tokens; NONE where they don't merge."""
        key = a << 32 | b
        slot = self._slot(key)
        out = np.full(len(key), NONE, np.int64)
        todo = np.arange(len(key))
        for step in range(self.probes):
            at = (slot[todo] + step) & self.mask
            held = self.keys[at]
            same = held == key[todo]
            out[todo[same]] = self.values[at[same]]
            todo = todo[~same & (held != -1)]
            if not len(todo):
                break
        return out

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        todo: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            known = self.ranks.get(piece)
            if known is not None:
                out[i] = [known]
            elif piece:
                todo.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, rows in todo.items():
            if len(rows) < FEW:
                for i in rows:
                    out[i] = self._merge_one(pieces[i], width)
                continue
            step = max(1, TREE_CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge_like([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge_one(self, piece: bytes, width: int) -> list[int]:
        """The same for one piece, with a tree in a list."""
        tokens, ranks = self.tokens, self.ranks
        none = int(NONE)
        n = len(piece)
        ids: list[int] = [ranks[piece[i : i + 1]] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def key(i: int, j: int) -> int:
            r = ranks.get(tokens[ids[i]] + tokens[ids[j]])
            return none if r is None else r * width + i

        def put(i: int, value: int) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        tree = [none] * width + [key(i, i + 1) for i in range(n - 1)] + [none] * (width - n + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, pos = divmod(tree[1], width)
            gone = after[pos]
            nxt, prev = after[gone], before[pos]
            ids[pos], ids[gone], after[pos] = rank, -1, nxt
            put(gone, none)
            if nxt < n:
                before[nxt] = pos
            put(pos, key(pos, nxt) if nxt < n else none)
            if prev >= 0:
                put(prev, key(prev, pos))
        return [i for i in ids if i >= 0]

    def _merge_like(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        cells = np.zeros(n * width, np.uint8)
        at = np.repeat(np.arange(n) * width - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        cells[at] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte_ids[cells]
        column = np.tile(np.arange(width), n)
        inside = column < np.repeat(lengths, width)
        paired = np.flatnonzero(column + 1 < np.repeat(lengths, width))
        # following and preceding live positions in the row, width and -1 at its ends
        after, before = column + 1, column - 1
        tree = np.full((2 * width, n), NONE, np.int64)
        leaf = np.full(n * width, NONE, np.int64)
        ranks = self.pair_ranks(ids[paired], ids[paired + 1])
        leaf[paired] = np.where(ranks < NONE, ranks * width + column[paired], NONE)
        tree[width:] = leaf.reshape(n, width).T
        for level in range(width - 1, 0, -1):
            np.minimum(tree[2 * level], tree[2 * level + 1], out=tree[level])
        live = np.flatnonzero(tree[1] < NONE)
        while len(live):
            best = tree[1, live]
            pos, rank = best % width, best // width
            base = live * width
            gone = after[base + pos]
            nxt = after[base + gone]
            ids[base + pos] = rank
            inside[base + gone] = False
            after[base + pos] = nxt
            has = nxt < lengths[live]
            before[(base + nxt)[has]] = pos[has]
            prev = before[base + pos]
            self._set(tree, width, live, gone, np.full(len(live), NONE))
            fresh = np.full(len(live), NONE)
            r = self.pair_ranks(rank[has], ids[(base + nxt)[has]])
            fresh[has] = np.where(r < NONE, r * width + pos[has], NONE)
            self._set(tree, width, live, pos, fresh)
            has = prev >= 0
            r = self.pair_ranks(ids[(base + prev)[has]], rank[has])
            self._set(tree, width, live[has], prev[has], np.where(r < NONE, r * width + prev[has], NONE))
            live = live[tree[1, live] < NONE]
        flat = ids[inside].tolist()
        ends = np.cumsum(inside.reshape(n, width).sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    @staticmethod
    def _set(tree: np.ndarray, width: int, row: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
        """Point update in each row's tree."""
        node = pos + width
        tree[node, row] = value
        node = node >> 1
        while len(node) and node[0]:
            tree[node, row] = np.minimum(tree[2 * node, row], tree[2 * node + 1, row])
            node = node >> 1


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.cut = Merges(path), regex.compile(pattern)
        self.kept: dict[str, list[int]] = {}
        self.numbers = [str(i) for i in range(len(self.merges.tokens))]

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        group: list[list[str]] = []
        size = 0
        for text in texts:
            pieces = self.cut.findall(text)
            group.append(pieces)
            size += len(pieces)
            if size > 200_000:
                yield from self._encode(group)
                group, size = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[list[int]]:
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        kept = self.kept
        new = list(set(chain.from_iterable(group)).difference(kept))
        kept.update(zip(new, self.merges.merge([x.encode() for x in new])))
        for pieces in group:
            yield list(chain.from_iterable(map(kept.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker."""
    return Codec(path, pattern)


def small_slices(column: pa.Array, rows: int = 512) -> Iterator[list[str]]:
    """Texts as Python strings, a few at a time; null is empty."""
    for k in range(0, len(column), rows):
        yield pc.fill_null(column.slice(k, rows), "").to_pylist()


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of its whole text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            done = 0
            for texts in small_slices(batch.column(1)):
                ids = pa.array(list(own.encode_batch(texts)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), ids], ["doc_id", "ids"])
                done += len(texts)

    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of its ids."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids alone, text by text."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, ids_hex, bytes_hex = [], [], []
            for texts in small_slices(batch.column(1)):
                for ids in own.encode_batch(texts):
                    counts.append(len(ids))
                    ids_hex.append(hashlib.sha256(" ".join(map(own.numbers.__getitem__, ids)).encode()).hexdigest())
                    bytes_hex.append(hashlib.sha256(own.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(digested, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
