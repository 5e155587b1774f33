"""Periodic runs of words by recompression.

The words of a block of documents, a separator of its own after each, are one string. Rounds of block compression (a
letter repeated k times becomes one symbol) and pair compression (letters are dealt to a left and a right side; a left
one before a right one becomes one symbol with it) shorten it by a constant factor each, until all symbols differ.
The rounds are the levels of a run-length grammar whose total size is linear. Where two texts are equal, their levels
are, but for a symbol at each end; so a query for the longest common extension of two positions climbs the levels as
long as they agree and comes down again where they part, with a step or two a level. All queries of a block are
answered side by side. The same levels, mirrored, answer extensions to the left.

A run of period q and at least four periods has q-apart equal words at 3q places in a row or more, so at a multiple of
3q. These places, n / 3q for each q and O(n log n) in all, are the candidates; those whose words agree there and beside
it are extended to both sides by the grammar. What comes out longest for the smallest period is the run.

Defined results: null, empty and blank texts have no words and no runs; rows are independent, so repeated ids, null ids
and other columns do not matter; empty tables give empty results. A text of any length is one row of a block by itself,
in memory proportional to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import give_back, raw_text, row_blocks
from .terms import TextBlock

#: Bytes of text whose words share a grammar, and candidates that are looked at together.
TOGETHER, CANDIDATES = 1 << 19, 1 << 20


@dataclass
class Level:
    """Symbols and an end mark; how they are grouped to those of the next level.

    ``parent`` is the next level's index of a position, ``first`` the position that an index starts at; ``left`` tells
    the side of each letter in a round of pairs and is None in a round of blocks. The last level has none of these.
    """

    symbols: np.ndarray
    first: np.ndarray | None = None
    parent: np.ndarray | None = None
    left: np.ndarray | None = None

    def grouped(self, starts: np.ndarray) -> None:
        self.first = np.append(np.flatnonzero(starts), len(starts))
        self.parent = np.append(np.cumsum(starts) - 1, len(self.first) - 1)

    def mirrored(self) -> Level:
        symbols = np.append(self.symbols[-2::-1], -1)
        if self.first is None:
            return Level(symbols)
        n, k = len(self.parent) - 1, len(self.first) - 1
        left = None if self.left is None else np.append(~self.left[-2::-1], False)
        return Level(symbols, n - self.first[::-1], np.append(k - 1 - self.parent[-2::-1], k), left)


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return pd.factorize(a * (int(b.max()) + 2) + b + 1)[0]


def _sides(symbols: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A side for each position, the same for equal letters; of some dealings the one that pairs most."""
    best, most = symbols == symbols[0], 0  # pairs each of its places but a last one
    for _ in range(3):
        left = rng.integers(0, 2, int(symbols.max()) + 1, dtype=np.int8).astype(bool)[symbols]
        for side in (left, ~left):
            if (pairs := np.count_nonzero(side[:-1] & ~side[1:])) > most:
                best, most = side, pairs
    return best


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels of the string, up to one whose symbols all differ."""
    rng, levels = np.random.default_rng(5), []
    while len(symbols) > 1 and len(pd.unique(symbols)) < len(symbols):
        starts = np.append(True, symbols[1:] != symbols[:-1])
        if not starts.all():
            level = Level(np.append(symbols, -1))
            level.grouped(starts)
            levels.append(level)
            symbols = _numbered(symbols[starts], np.diff(level.first))
            if len(symbols) == 1:
                break
        left = _sides(symbols, rng)
        pairs = left[:-1] & ~left[1:]
        starts = np.append(True, ~pairs)
        level = Level(np.append(symbols, -1), left=np.append(left, False))
        level.grouped(starts)
        levels.append(level)
        symbols = _numbered(symbols[starts], np.where(np.append(pairs, False), np.append(symbols[1:], -1), -1)[starts])
    return [*levels, Level(np.append(symbols, -1))]


def common_extensions(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j on are equal, for arrays of different positions i and j."""
    at, x, y, parted = np.arange(len(i)), i, j, []
    for level in levels:
        same = level.symbols[x] == level.symbols[y]
        stay = [(at[~same], x[~same], y[~same])]
        at, x, y = at[same], x[same], y[same]
        if level.first is not None and len(at):
            if level.left is None:
                px, py = level.parent[x], level.parent[y]
                more_x, more_y = level.first[px + 1] - x, level.first[py + 1] - y
                whole = (level.first[px] == x) & (level.first[py] == y)
                step, go_on = np.where(whole, 0, np.minimum(more_x, more_y)), whole | (more_x == more_y)
                x, y = x + step, y + step
                stay.append((at[~go_on], x[~go_on], y[~go_on]))
                at, x, y = at[go_on], x[go_on], y[go_on]
            else:
                step = ~level.left[x]  # one of the right side ends what it is in
                x, y = x + step, y + step
            x, y = level.parent[x], level.parent[y]
        parted.append([np.concatenate(part) for part in zip(*stay)])
    at, x, y = parted.pop()
    for level in reversed(levels[:-1]):
        x, y = level.first[x], level.first[y]
        step = level.symbols[x] == level.symbols[y]
        if level.left is None:
            run = np.minimum(level.first[level.parent[x[step]] + 1] - x[step], level.first[level.parent[y[step]] + 1] - y[step])
            step = step.astype(np.int64)
            step[step > 0] = run
        x, y = x + step, y + step
        at, x, y = (np.concatenate(both) for both in zip((at, x, y), parted.pop()))
    out = np.empty(len(i), np.int64)
    out[at] = x - i[at]
    return out


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places 0, 3q, 6q ... and periods q of a text of n words, up to a quarter of it, a bounded number at a time."""
    q = np.arange(1, n // 4 + 1)
    counts = (n - 1 - q) // (3 * q) + 1
    sums = np.cumsum(counts)
    a = 0
    while a < len(q):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] - counts[a] + CANDIDATES, "right")))
        own, periods = counts[a:b], np.repeat(q[a:b], counts[a:b])
        yield (np.arange(len(periods)) - np.repeat(np.cumsum(own) - own, own)) * 3 * periods, periods
        a = b


def _extended(string: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, length and period around candidates of all texts, which begin at ``begins`` in the string."""
    levels: list[list[Level]] = []
    held, count = [], 0

    def answer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not levels:
            levels.append(grammar(string))
            levels.append([level.mirrored() for level in levels[0]])
        i, q = (np.concatenate(x) for x in zip(*held))
        last = len(string) - 1
        ahead, back = common_extensions(levels[0], i, i + q), common_extensions(levels[1], last - i - q, last - i)
        return i - back + 1, ahead + back - 1 + q, q

    for k in np.flatnonzero(sizes >= 6):
        for place, q in _grid(int(sizes[k])):
            i = begins[k] + place
            i, q = (x[string[i] == string[i + q]] for x in (i, q))
            beside = (string[i + 1] == string[i + q + 1]) | (string[i - 1] == string[i + q - 1])
            held.append((i[beside], q[beside]))
            count += len(held[-1][0])
            if count >= CANDIDATES:
                yield answer()
                held, count = [], 0
    if count:
        yield answer()


def word_runs(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start and period; texts are ranges ``rows`` of the words' codes."""
    sizes = np.diff(rows)
    marks = (int(codes.max()) + 1 if len(codes) else 0) + np.arange(len(sizes) + 1)
    string = np.insert(codes, rows, marks)  # a separator before the first text and after each
    begins = rows[:-1] + 1 + np.arange(len(sizes))
    found = np.zeros((0, 3), np.int64)
    for start, length, period in _extended(string, begins, sizes):
        ok = length >= np.maximum(6, 4 * period)
        found = np.concatenate((found, np.stack((start[ok], period[ok], length[ok]), 1)))
        found = found[np.lexsort((found[:, 1], found[:, 2], found[:, 0]))]
        found = found[np.append(True, (found[1:, [0, 2]] != found[:-1, [0, 2]]).any(1))[: len(found)]]  # the smallest period
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    start = found[:, 0] - np.searchsorted(begins, found[:, 0], "right")  # without separators
    return start, found[:, 2], found[:, 1]


def _found(block: TextBlock) -> list[pa.Array]:
    """For each text its number of words, its runs, and its words without those that a run repeats."""
    start, length, period = word_runs(block.codes()[0], block.rows)
    covers = np.zeros(len(block.starts) + 1, np.int64)
    np.add.at(covers, start + period, 1)
    np.add.at(covers, start + length, -1)
    text = np.searchsorted(block.rows, start, "right") - 1
    fields = [pa.array(x.astype(np.int64)) for x in (start - block.rows[text], length, period)]
    runs = pa.ListArray.from_arrays(np.searchsorted(text, np.arange(len(block.rows))).astype(np.int32), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return [pa.array(np.diff(block.rows), pa.int64()), runs, block.joined(np.cumsum(covers[:-1]) == 0).cast(pa.string())]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of each row.

    Words are runs of characters but ASCII white space. A run is a longest stretch of words with smallest period q, at
    least six words and four periods long; the collapsed text drops what follows a run's first period.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_text(batch.column(1))
            for a, b in row_blocks(offsets, TOGETHER):
                columns = _found(TextBlock(data, offsets[a : b + 1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], ["doc_id", "n_words", "runs", "collapsed"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
