"""A map of fixed size that tells which rows can't be in a set of ids, so that their texts need not be moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits of a map: half a megabyte goes to every task, whatever the number of ids.
MAP_BITS = 1 << 22


def id_map(ids: DataFrame) -> np.ndarray:
    """One bit for each hash of the ids in the only column of ``ids``; gathered in a bounded number of 4 KB parts."""
    bit = F.pmod(F.xxhash64(ids.columns[0]), F.lit(MAP_BITS)) + 1  # bitmaps count from 1
    parts = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    held = np.zeros(MAP_BITS // 8, np.uint8)
    for row in parts.collect():
        at = (row["part"] - 1) * 4096
        held[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return held


def possible_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, and few others (many, if ids are over a million): filter before
    a join that moves whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(id_map(ids))

    @F.arrow_udf(BooleanType())
    def held(bits: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for bit in bits:
            b = bit.to_numpy(zero_copy_only=False)
            yield pa.array((own[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool))

    return docs.where(held(F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))))
