"""Token counts kept by signed deltas.

Inserts, deletes and revised counts of documents become signed sums by source, language and tokenizer version. A batch
is summed before it is stored, under its own name; a commit record makes it count. Storing a batch again replaces it,
committing it again changes nothing, and totals read committed batches only. ``fold`` writes the totals so far down
with the batches that are in them; from then on only that table and the deltas of the batches since are read. The driver
holds names of batches, no rows of theirs.

Defined results: null texts have 0 tokens; null sources and languages are groups of their own; repeated rows are
counted as often as they come; groups whose documents and tokens come to 0 are left out of totals; a store without
batches has empty totals. Other columns are not touched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import small_slices
from .packing import tokenizer

KEYS = ("source", "lang", "tokenizer_version")
DELTAS = "batch_id string, source string, lang string, tokenizer_version string, d_docs long, d_tokens long"


def token_counts(docs: DataFrame, path: str, pattern: str, version: str) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens of every whole text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(text)) for texts in small_slices(batch.column(3)) for text in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    out = rows.mapInArrow(counted, rows.drop("text").schema.add("n_tokens", "long"))
    return out.withColumn("tokenizer_version", F.lit(version))


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas that add documents."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Deltas that take documents away again."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("d_docs"), (-F.col("n_tokens")).alias("d_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace counts."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Totals under ``path``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self, kind: str) -> str:
        return f"{self.path}/{kind}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Store and commit a batch; False if it was committed before."""
        mark = f"{self._batches('commits')}/{batch_id}"
        if self._exists(f"{mark}/_SUCCESS"):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.where("d_docs <> 0 or d_tokens <> 0").select(F.lit(batch_id).alias("batch_id"), "*").write.mode("overwrite").parquet(f"{self._batches('deltas')}/{batch_id}")
        self.spark.range(1).select(F.lit(batch_id).alias("batch_id")).coalesce(1).write.mode("overwrite").parquet(mark)
        return True

    def committed(self) -> list[str]:
        """Names of the committed batches, those whose commit record is complete."""
        return sorted(name for name in self._names("commits") if self._exists(f"{self._batches('commits')}/{name}/_SUCCESS"))

    def _names(self, kind: str) -> list[str]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._batches(kind))
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _folded(self) -> str | None:
        """The newest table of totals that is complete: the list of its batches is written last."""
        numbers = sorted(map(int, self._names("totals")), reverse=True)
        return next((p for p in (f"{self._batches('totals')}/{n}" for n in numbers) if self._exists(f"{p}/batches/_SUCCESS")), None)

    def _state(self) -> tuple[str | None, list[str], list[str]]:
        """The folded totals, the batches in them, and those committed since. All that is read or written for one
        answer goes by one state, whatever is committed meanwhile."""
        folded = self._folded()
        done = [r["batch_id"] for r in self.spark.read.schema("batch_id string").parquet(f"{folded}/batches").collect()] if folded else []
        return folded, done, sorted(set(self.committed()) - set(done))

    def _sums(self, folded: str | None, new: list[str]) -> DataFrame:
        """Signed sums of what is folded and of some batches since; nothing else is read."""
        sums = "source string, lang string, tokenizer_version string, d_docs long, d_tokens long"
        parts = [self.spark.read.schema(DELTAS).parquet(*(f"{self._batches('deltas')}/{name}" for name in new)).drop("batch_id")] if new else []
        parts += [self.spark.read.schema(sums).parquet(f"{folded}/sums")] if folded else []
        both = functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], sums)
        return both.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).where("d_docs <> 0 or d_tokens <> 0")

    def fold(self) -> None:
        """Write the totals down. A fold that fails half-way is passed over and done again; a batch committed during a
        fold is left to the next one."""
        folded, done, new = self._state()
        if not new:
            return
        to = f"{self._batches('totals')}/{int(folded.rpartition('/')[2]) + 1 if folded else 0}"
        self._sums(folded, new).write.mode("overwrite").parquet(f"{to}/sums")
        self.spark.createDataFrame([(name,) for name in [*done, *new]], "batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{to}/batches")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens."""
        folded, _, new = self._state()
        return self._sums(folded, new).select(*KEYS, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens"))
