"""Exact deduplication with a split for frequent digests.

Misra-Gries summaries of every partition are added up and name the digests that may hold more than one row in
``HEAVY_SHARE``. Their counts are then verified over all rows; the verified winners, a bounded set, are broadcast
and settle their rows map-side. All other digests meet in an ordinary shuffle: their groups are aggregated and joined
to their rows.

Defined results: null text counts as empty; texts are equal when identical; of equal texts the largest doc_id stays
(null doc_id counts as smallest); rows that repeat both text and doc_id of the winner tie, all are marked kept in
``copy_groups`` and one of them stays in ``distinct_documents``. Empty tables give empty results; other columns pass
through ``distinct_documents`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .hashing import give_back

#: A digest is frequent if at least one row in so many has it: at most so many digests can be.
HEAVY_SHARE = 512


def misra_gries(keys: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """Counts of at most ``counters`` keys, each too low by at most n / (counters + 1)."""
    held: dict[bytes, int] = {}
    for key in keys:
        if key in held:
            held[key] += 1
        elif len(held) < counters:
            held[key] = 1
        else:
            held = {k: v - 1 for k, v in held.items() if v > 1}
    return held


def _summaries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    held = misra_gries((key for batch in batches for key in batch.column(0).to_pylist()), counters)
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "low"])
    held.clear()
    give_back()


def heavy_digests(digests: DataFrame, share: int = HEAVY_SHARE) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that have at least one row in ``share``.

    With 2 * share counters a summary is too low by at most half of that, and all summed counters stay under the
    number of rows: at most 2 * share candidates are verified, at most ``share`` come out.
    """
    rows = digests.count()
    counters = 2 * share
    summed = digests.select("digest").mapInArrow(lambda it: _summaries(it, counters), "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    candidates = summed.where(F.col("low") * counters >= rows)
    verified = digests.join(F.broadcast(candidates.select("digest")), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return verified.where((F.col("group_size") * share >= rows) & (F.col("group_size") > 1))


def _digested(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digest", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))


def copy_groups(docs: DataFrame, share: int = HEAVY_SHARE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(_digested(docs.select("doc_id", "text")).drop("text"), "digests")
    heavy = written(heavy_digests(digests, share), "heavy")
    light = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    # joined and not a window, whose groups no task could share
    groups = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    light = light.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size")
    both = digests.join(F.broadcast(heavy), "digest").select(light.columns).unionByName(light)
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, share: int = HEAVY_SHARE) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text.

    Copies of frequent texts are removed before anything is shuffled; what is left moves once.
    """
    digests = written(_digested(docs.select("doc_id", "text")).drop("text"), "digests")
    heavy = F.broadcast(written(heavy_digests(digests, share), "heavy").select(F.col("digest").alias("_heavy"), F.col("keep_id").alias("_keep")))
    # whole rows in one column, so that no name of theirs can clash
    whole = F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns))
    rows = docs.select(whole.alias("_row"), F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("_digest"))
    rows = rows.join(heavy, F.col("_digest") == F.col("_heavy"), "left").where(F.col("_heavy").isNull() | F.col("_row.doc_id").eqNullSafe(F.col("_keep")))
    order = Window.partitionBy("_digest").orderBy(F.col("_row.doc_id").desc_nulls_last())
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select("_row.*")
