"""Incremental and time-based behaviour as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path

#: A time after all others, that closes windows.
END = "9999-01-01 00:00:00"


def replay(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A Parquet table as a stream of files, zone-less times read as UTC."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may match one file as well as a folder
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read back what it wrote. In complete mode the last batch stands for all.

    Batches are written under their ids, so one that is run again replaces itself.
    """
    spark = df.sparkSession
    out, schema = new_path(spark, "stream"), df.schema
    last: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'batch={batch_id}'}")
        last.append(batch_id)

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def windows_drained(stream: DataFrame, time: str, windows: Callable[[DataFrame], DataFrame], told: list[dict] | None = None) -> DataFrame:
    """What ``windows(stream)``, a windowed aggregate behind a watermark on ``time``, emits in append mode.

    A window is emitted once, when the watermark has passed it, and leaves the state; so the state holds the windows
    that are still open, however long the stream is. When all that is there is read, one row at the end of time, null but
    for ``time``, closes what is open; its own windows never close. Rows later than the watermark are not counted: the
    delay is the lateness that ``windows`` allows. ``told`` gets the progress of every batch.
    """
    spark = stream.sparkSession
    out, ends, at = (new_path(spark, name) for name in ("stream", "stream-end", "stream-checkpoint"))
    end = [F.lit(END if c == time else None).cast(stream.schema[c].dataType).alias(c) for c in stream.columns]
    last = spark.range(1).select(*end)
    last.limit(0).write.parquet(ends)
    closing = windows(stream.unionByName(spark.readStream.schema(stream.schema).parquet(ends)))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def run() -> None:
        query = closing.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
        if told is not None:
            told.extend(query.recentProgress)

    run()
    last.write.mode("append").parquet(ends)
    run()
    return spark.read.schema(closing.schema).option("recursiveFileLookup", True).parquet(out)


def latest_of_runs(runs: DataFrame, key: list[str], kept: list[str]) -> DataFrame:
    """One row of each key out of several runs: the columns of its latest ``run``, but those in ``kept`` of its first."""
    rest = [c for c in runs.columns if c not in (*key, *kept, "run")]
    own = runs.groupBy(*key).agg(F.max_by(F.struct(*rest), "run").alias("_new"), F.min_by(F.struct(*kept), "run").alias("_old"))
    return own.select(*key, "_new.*", "_old.*").select(*(c for c in runs.columns if c != "run"))


def upsert_stream(stream: DataFrame, fold: Callable[[DataFrame], DataFrame], key: list[str], kept: list[str], fan: int = 4, sizes: list[int] | None = None) -> DataFrame:
    """Fold a stream of upserts into a table image: ``fold(batch)`` gives one row of each key that a batch touches.

    A batch writes its own rows only, as a run. ``fan`` runs of one level become one of the next, so a row is written
    once for each level (the logarithm of the batches) whatever the image holds; a read merges a few runs of each level.
    Of a key the latest batch counts, ``kept`` columns stay as they first came. A run counts once it is whole; a batch that is
    delivered again after that changes nothing. Without files the image is empty. ``sizes`` gets the rows of every
    batch's writes.
    """
    spark = stream.sparkSession
    out, schema = new_path(spark, "runs"), fold(stream).schema
    runs: list[tuple[int, int, str]] = []  # level, last batch, path; oldest first

    def read(some: list[tuple[int, int, str]]) -> DataFrame:
        tables = [spark.read.schema(schema).parquet(path).withColumn("run", F.lit(last)) for _, last, path in some]
        return latest_of_runs(reduce(DataFrame.unionByName, tables), key, kept)

    def write(batch: DataFrame, batch_id: int) -> None:
        if runs and batch_id <= runs[-1][1]:
            return
        path = f"{out}/level=0/batch={batch_id}"
        fold(batch).write.mode("overwrite").parquet(path)
        now, wrote = [*runs, (0, batch_id, path)], [path]
        while len(now) >= fan and now[-fan][0] == now[-1][0]:
            level, path = now[-1][0] + 1, f"{out}/level={now[-1][0] + 1}/batch={batch_id}"
            read(now[-fan:]).write.mode("overwrite").parquet(path)
            now[-fan:] = [(level, batch_id, path)]
            wrote.append(path)
        runs[:] = now
        if sizes is not None:
            sizes.append(sum(spark.read.parquet(p).count() for p in wrote))

    stream.writeStream.foreachBatch(write).option("checkpointLocation", new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return read(runs) if runs else spark.createDataFrame([], schema)


def admitted(hits: list[int], now: int, limit: int, window_us: int) -> tuple[bool, list[int]]:
    """Whether a hit at ``now`` is admitted, and the admitted hits that still count; those strictly older go."""
    kept = [t for t in hits if now - t <= window_us]
    if limit <= 0:
        return True, kept
    return (True, [*kept, now]) if len(kept) < limit else (False, kept)


def rate_limited(stream: DataFrame, key: str, limit: int, window_seconds: int = 60, lateness: str = "1 day") -> DataFrame:
    """event_id, key, at, allowed: at most ``limit`` admitted hits a key in the trailing window.

    Hits are taken in order of their time within a batch, batches as they come. State holds at most ``limit`` times a
    key and goes when the watermark, ``lateness`` behind the newest hit, is two windows past the key's last hit; hits
    later than that are not seen. Time is that of events, so a stream that has ended asks for no more batches.
    """
    window = window_seconds * 1_000_000

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"event_id": [], "key": [], "at": [], "allowed": []}).astype({"event_id": "int64", "key": "object", "at": "int64", "allowed": "bool"})
            return
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for event_id, at in zip(rows["event_id"], rows["at"]):
            ok, hits = admitted(hits, int(at), limit, window)
            out.append((event_id, keys[0], at, ok))
        state.update((hits,))
        state.setTimeoutTimestamp(max(int(rows["at"].max()) // 1000 + 2 * window_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "key", "at", "allowed"])

    rows = stream.withWatermark("ts", lateness).select("event_id", F.col(key).cast("string").alias("key"), F.unix_micros("ts").alias("at"), "ts")
    return rows.groupBy("key").applyInPandasWithState(step, "event_id long, key string, at long, allowed boolean", "hits array<long>", "append", "EventTimeTimeout")


def on_time(stream: DataFrame, event: Column, arrived: Column, seconds: int = 300) -> DataFrame:
    """Rows whose event time is within ``seconds`` of their arrival, either way."""
    return stream.where(F.abs(F.unix_micros(arrived) - F.unix_micros(event)) <= seconds * 1_000_000)
