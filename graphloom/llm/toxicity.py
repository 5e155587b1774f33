"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the sets of its words, its words cut to four bytes (a light stem), its word pairs and its
pairs with one or two words between, hashed into 2 ** BITS slots. Per-coordinate learning rates and an L1 penalty
leave few non-zero weights, which go to every task: 12 bytes each, of at most SAMPLE_ROWS texts and 2 ** BITS slots.

Labels are taken only from rows whose crc32 of the id (as text) modulo 4 is not 2. Defined results: null texts,
empty ones and those without a word score the share of toxic labels; texts are read whole; repeated rows score alike; without
labels of both kinds every score is the share of toxic labels (0 without any). Label rows with nulls are left out; of
several labels of an id the highest counts, of several texts of a labelled id the first in order is learned. Columns of the input pass through untouched; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .hashing import NOT_WORD, Words, give_back, raw_text, row_blocks

BITS = 22
#: Labelled rows that the weights are fitted on, at most: those of the lowest hashes of their ids, whatever the label,
#: so that tables of any size teach the same share of toxic texts.
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3
STEM_BYTES = 4
#: Slots of a text that travel in one row, at most: Spark fills Arrow batches by rows, 10,000 unless told otherwise, so
#: those of the task that learns take some 10 MB, however long the texts are.
PIECE = 256


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots, and the row of each, of a block of texts; repeated ones are still in."""
    words = Words(data, offsets, NOT_WORD, lower=True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.rows))
    stems = words.range_hashes(words.starts, np.minimum(words.ends, words.starts + STEM_BYTES))
    shift = np.uint64(64 - BITS)
    # words and stems share the lower half, pairs the upper one: pairs are many and must not land on words
    half = np.uint64(1 << (BITS - 1))
    slots, rows = [(words.hashes >> shift) >> np.uint64(1), ((stems ^ np.uint64(0x5BD1E995)) >> shift) >> np.uint64(1)], [row, row]
    last = words.rows[1:][row] if len(row) else row
    for gap in (0, 1, 2):
        fits = np.arange(len(row)) + 1 + gap < last
        slots.append((((words.grams(2, gap) >> shift) >> np.uint64(1)) | half)[fits])
        rows.append(row[fits])
    return np.concatenate(slots).astype(np.int64), np.concatenate(rows)


@dataclass
class Ftrl:
    """Follow the regularised leader, proximal, one rate for each coordinate."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.5
    z: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _slot_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct slots of each text (key, label, text), in pieces; a text without any has an empty one."""
    for batch in batches:
        data, offsets = raw_text(batch.column(2))
        for a, b in row_blocks(offsets):
            slots, row = _features(data, offsets[a : b + 1])
            own = np.unique(row * np.int64(1 << BITS) + slots)
            cut = np.searchsorted(own >> BITS, np.arange(b - a + 1))
            many = np.maximum(-(-np.diff(cut) // PIECE), 1)
            text = np.repeat(np.arange(b - a), many)
            piece = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
            starts = np.append(cut[text] + piece * PIECE, cut[-1]).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(starts), pa.array((own & ((1 << BITS) - 1)).astype(np.int32)))
            key, label = (batch.column(k).take(pa.array(a + text)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([key, label, pa.array(piece, pa.int32()), sets], ["key", "label", "piece", "slots"])
    batch = data = slots = row = own = sets = key = label = None
    give_back()


def _trained(batches: Iterator[pa.RecordBatch], epochs: int) -> Iterator[pa.RecordBatch]:
    """Weights of a bounded sample, learned in an order that hashes of ids fix."""
    held: list[np.ndarray] = []
    heads = [np.empty((0, 6), np.int64)]
    for batch in batches:
        key, label, piece, sets = batch.columns
        cut = sets.offsets.to_numpy().astype(np.int64)
        heads.append(np.column_stack([key, piece, label, np.full(len(key), len(held)), cut[:-1], cut[1:]]))
        held.append(sets.values.to_numpy())
    rows = np.concatenate(heads)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    texts = np.split(rows, np.flatnonzero(rows[:, 1] == 0))[1:]
    model = Ftrl()
    for _ in range(epochs):
        for text in texts:
            model.learn(np.concatenate([held[k][a:b] for k, a, b in text[:, 3:].tolist()]).astype(np.int64), int(text[0, 2]))
    held.clear()
    batch = sets = None
    at = np.flatnonzero(np.abs(model.z) > model.l1)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(model.weights(at), pa.float64())], ["slot", "weight"])
    model = None
    give_back()


def fit_toxicity(docs: DataFrame, labels: DataFrame, epochs: int = 3, sample: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, weights and the share of toxic labels.

    All tasks look for the sampled rows and turn them into slots; only those meet in the one task that learns.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("_label")).where("doc_id is not null and _label is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("_label").alias("_label"))
    counts = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return np.empty(0, np.int64), np.empty(0), share
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), F.col("_label").alias("label"), "text")
    sets = keyed.mapInArrow(_slot_sets, "key long, label int, piece int, slots array<int>")
    got = sets.repartition(1).mapInArrow(lambda it: _trained(it, epochs), "slot long, weight double").toPandas()
    return got["slot"].to_numpy(), got["weight"].to_numpy(), share


def score_column(spark: SparkSession, text: Column, model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    """The score of the whole text; only the text goes to Python."""
    slots, weights, share = model
    shared = spark.sparkContext.broadcast((slots, weights.astype(np.float32)))

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        slots, weights = shared.value
        table = np.zeros((1 << BITS) + 1, np.float32)
        table[slots] = weights
        for batch in batches:
            data, offsets = raw_text(batch)
            out = []
            for a, b in row_blocks(offsets):
                at, row = _features(data, offsets[a : b + 1])
                hit = table[at] != 0
                pairs = np.unique(row[hit] * np.int64(1 << BITS) + at[hit])
                logit = table[-1] + np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], b - a)
                known = (np.bincount(row, minlength=b - a) > 0) & (len(slots) > 0)
                out.append(np.where(known, 1 / (1 + np.exp(-np.clip(logit, -35, 35))), share))
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
        table = batch = data = None
        give_back()

    return score(text)


def toxicity_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = docs.select("doc_id", score_column(docs.sparkSession, F.col("text"), model).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they came; nothing is shuffled."""
    return docs.where(score_column(docs.sparkSession, F.col("text"), model) < THRESHOLD)
