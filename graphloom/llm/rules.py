"""Quality rules: an ordered decision list learned by sequential covering.

Statistics of every text are counted in Arrow batches. From a bounded sample of labelled rows, rules for low quality
are grown on two thirds (one threshold at a time, by the gain in information) and pruned on the last third, until a
new rule no longer helps. The list is emitted as one ordered Spark conditional expression.

Defined results: null texts have no words, all counts are 0 and base_failed is true; texts of any length are counted
whole; repeated rows are judged alike; without usable labels the list is empty and only the base rules decide.
Labels with nulls are left out; of several labels of an id the highest counts, of several texts of a labelled id the
first in order is learned from. Empty tables give empty results; columns of the input pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .hashing import SPACE, Words, give_back, raw_text, row_blocks

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_distinct_words", "n_upper", "n_exclaims", "n_digits", "n_lines")
#: Labelled rows that the list is learned from, at most (those of the lowest hashes of their ids).
SAMPLE = 12_000
SYMBOLS = b"#*$%&|<>"


def _marked(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _CONT = _marked(SYMBOLS), _marked(bytes(range(65, 91))), _marked(bytes(range(48, 58))), _marked(bytes(range(128, 192)))


def repeated_words(hashes: np.ndarray, window: int = 5) -> int:
    """Words that lie in a window of so many words which the text has twice or more, first ones included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    codes = np.unique(hashes, return_inverse=True)[1].astype(np.uint64)
    grams = codes[:n].copy()
    for k in range(1, window):
        grams = np.unique(grams * np.uint64(len(hashes)) + codes[k : n + k], return_inverse=True)[1].astype(np.uint64)
    twice = np.bincount(grams.astype(np.int64))[grams.astype(np.int64)] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines)), len(lines)


@F.arrow_udf(StructType([StructField(k, LongType()) for k in BASE + MORE]))
def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The counts of every whole text as one struct; only the text goes to Python."""
    for batch in batches:
        data, offsets = raw_text(batch)
        cols: dict[str, list[np.ndarray]] = {k: [] for k in BASE + MORE}
        for a, b in row_blocks(offsets):
            words = Words(data, offsets[a : b + 1])
            raw, off = words.bytes, words.offsets

            def per_row(mask: np.ndarray, off: np.ndarray = off) -> np.ndarray:
                sums = np.zeros(len(mask) + 1, np.int64)
                np.cumsum(mask, out=sums[1:])
                return np.diff(sums[off])

            cols["n_words"].append(np.diff(words.rows))
            cols["word_chars"].append(per_row(~SPACE[raw] & ~_CONT[raw]))
            for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT)):
                cols[name].append(per_row(table[raw]))
            cols["n_exclaims"].append(per_row(raw == 33))
            bounds = list(zip(words.rows[:-1].tolist(), words.rows[1:].tolist()))
            cols["n_repeat_words"].append(np.array([repeated_words(words.hashes[i:j]) for i, j in bounds], np.int64))
            cols["n_distinct_words"].append(np.array([len(np.unique(words.hashes[i:j])) for i, j in bounds], np.int64))
            lines = np.array([_duplicate_lines(raw[i:j].tobytes()) for i, j in zip(off[:-1].tolist(), off[1:].tolist())], np.int64).reshape(-1, 2)
            cols["n_dup_lines"].append(lines[:, 0])
            cols["n_lines"].append(lines[:, 1])
        yield pa.StructArray.from_arrays([pa.array(np.concatenate(cols[k]) if cols[k] else np.empty(0, np.int64), pa.int64()) for k in BASE + MORE], list(BASE + MORE))
    give_back()


def text_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (and the columns ``more``) and the counts of every whole text."""
    return docs.select("doc_id", *more, _counted("text").alias("_counts")).select("doc_id", *more, "_counts.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: What the rules may test, as SQL over the counts; all are shares or means, so that length alone decides nothing.
FEATURES = {
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaim_share": "n_exclaims / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Test:
    """One threshold: ``feature`` over (or at most) ``cut``."""

    feature: str
    over: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.over else '<='} {self.cut!r}D"


def _covered(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= (x[t.feature] > t.cut) == t.over
    return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> list[Test]:
    """Add the threshold of the highest gain until only rows of the class are covered."""
    rule: list[Test] = []
    inside = np.ones(len(y), bool)
    while True:
        p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
        if not p0 or not n0:
            break
        best, base = (1e-9, None), np.log2(p0 / (p0 + n0))
        for name, values in x.items():
            v, t = values[inside], y[inside]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            pos = np.cumsum(t)[cuts]
            neg = cuts + 1 - pos
            for over, p, n in ((False, pos, neg), (True, p0 - pos, n0 - neg)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-12) / (p + n)) - base), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Test(name, over, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _covered(rule, x, len(y))
    return rule


def _worth(rule: list[Test], x: dict[str, np.ndarray], y: np.ndarray) -> float:
    hit = _covered(rule, x, len(y))
    p, n = int((hit & y).sum()), int((hit & ~y).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(x: dict[str, np.ndarray], y: np.ndarray, seed: int = 7, precision: float = 0.9) -> list[list[Test]]:
    """Rules for the rows where ``y`` holds, in the order found. A rule is kept if, on rows it was not grown on, at
    least ``precision`` of what it covers is of the class; the first that isn't ends the list, as do fewer than three
    rows of the class. Nothing else bounds the number of rules or of their conditions."""
    rng, rules = np.random.default_rng(seed), []
    left = np.arange(len(y))
    while y[left].sum() >= 3:
        part = rng.permutation(left)
        grow, prune = part[: 2 * len(part) // 3], part[2 * len(part) // 3 :]
        rule = _grow({k: v[grow] for k, v in x.items()}, y[grow])
        px, py = {k: v[prune] for k, v in x.items()}, y[prune]
        worth = [_worth(rule[:k], px, py) for k in range(1, len(rule) + 1)]
        if not worth:
            break
        rule = rule[: int(np.argmax(worth)) + 1]
        if (max(worth) + 1) / 2 < precision:
            break
        hit = _covered(rule, {k: v[left] for k, v in x.items()}, len(left))
        if not hit.any():
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def rules_column(rules: list[list[Test]]) -> Column:
    """True where no rule of the list holds: an ordered conditional, first rule first."""
    if not rules:
        return F.lit(True)
    cases = " ".join(f"WHEN {' AND '.join(t.sql() for t in rule)} THEN false" for rule in rules)
    return F.expr(f"CASE {cases} ELSE true END")


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Test]]:
    """The decision list from at most ``sample`` labelled rows: their counts, a few numbers a row, are gathered."""
    chosen = labels.select("doc_id", F.col("quality").cast("int").alias("_quality")).where("doc_id is not null and _quality is not null").groupBy("doc_id").agg(F.max("_quality").alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = text_statistics(rows, "_quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    # a filter before the sort would have Spark count twice: for the filter, and for what passes it
    got = rows.select("_quality", base_failed().alias("_failed"), *(F.expr(sql).cast("double").alias(k) for k, sql in FEATURES.items())).toPandas()
    got = got[~got["_failed"].astype(bool)]
    if not len(got):
        return []
    return learn_rules({k: got[k].to_numpy() for k in FEATURES}, (got["_quality"] == 0).to_numpy())


def judged(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document."""
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules_column(rules))


def passing(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they came; nothing is shuffled."""
    row = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))
    counted = docs.select(row.alias("_row"), _counted("text").alias("_counts")).select("_row", "_counts.*")
    return counted.where(~base_failed() & rules_column(rules)).select("_row.*")
