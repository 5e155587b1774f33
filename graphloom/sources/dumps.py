"""Dumps of the graph as tagged JSON lines, viewer payloads, audit rows and run records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graphs
from ..session import written


def dump_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(value) one JSON line per row, tagged by its table; tables keep the order given."""
    parts = [df.select(F.to_json(F.struct(F.lit(name).alias("table"), F.struct(*df.columns).alias("row"))).alias("value"), F.lit(k).alias("_k")) for k, (name, df) in enumerate(tables.items())]
    return reduce(DataFrame.unionByName, parts).drop("_k")


def write_dump(tables: dict[str, DataFrame], path: str) -> None:
    dump_lines(tables).write.text(path)


def read_dump(spark: SparkSession, path: str, schemas: dict[str, str], target: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Tables of a dump. Refuses tables that ``schemas`` doesn't name, and targets that are not empty; nodes without a
    canonical pointer come before aliases."""
    for name, df in (target or {}).items():
        if not df.isEmpty():
            raise ValueError(f"{name} is not empty")
    lines = spark.read.text(path).withColumn("table", F.get_json_object("value", "$.table"))
    other = lines.where(~F.col("table").isin(*schemas) | F.col("table").isNull()).limit(1).collect()
    if other:
        raise ValueError(f"unknown table {other[0]['table']}")
    out = {}
    for name, schema in schemas.items():
        rows = lines.where(F.col("table") == name).select(F.from_json(F.get_json_object("value", "$.row"), schema).alias("r")).select("r.*")
        out[name] = rows
    return out


def graph_view(nodes: DataFrame, edges: DataFrame, most: int, starts: DataFrame | None = None, depth: int = 1) -> DataFrame:
    """(kind, payload) JSON for a viewer: the first ``most`` nodes by id, and edges between them; ``</`` is escaped.

    With ``starts`` (start_id) only what lies within ``depth`` steps of them, either way, aliases included.
    """
    if starts is None:
        own = nodes.where("canonical_node_id is null")
    else:
        near = graphs.khop_nodes(edges, starts, max(1, depth)).select("node_id").distinct()
        own = nodes.join(near, "node_id", "left_semi")
    kept = written(own.orderBy("node_id").limit(most).select("node_id", "name", "node_type"), "view")
    ids = kept.select("node_id")
    inner = edges.join(ids.toDF("source_id"), "source_id", "left_semi").join(ids.toDF("target_id"), "target_id", "left_semi")
    safe = lambda c: F.replace(c, F.lit("</"), F.lit("<\\/"))
    a = kept.select(F.lit("node").alias("kind"), safe(F.to_json(F.struct(F.col("node_id").alias("id"), "name", F.col("node_type").alias("type")))).alias("payload"))
    return a.unionByName(inner.select(F.lit("edge").alias("kind"), safe(F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "relationship"))).alias("payload")))


def audit_rows(results: DataFrame, subject: Column, groups: Column, tool: str, params: Column, now: Column, most: int = 100) -> DataFrame:
    """One audit row per request: its result ids (at most ``most``, the smallest) and their number.

    The number is an aggregate; the ids are ranked no further than ``most`` before and after they move, so no task holds
    all results of a request.
    """
    counts = results.groupBy("request_id").agg(F.count(F.lit(1)).cast("int").alias("result_count"))
    first = results.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy(F.col("node_id").asc_nulls_last()))).where(F.col("_n") <= most)
    out = counts.join(first.groupBy("request_id").agg(F.array_sort(F.collect_list("node_id")).alias("result_ids")), "request_id")
    return out.select("request_id", now.alias("occurred_at"), subject.alias("subject"), groups.alias("groups"), F.lit(tool).alias("tool"), params.alias("params"), "result_ids", "result_count")


def closed_runs(runs: DataFrame, ends: DataFrame) -> DataFrame:
    """Open runs with what their ends (run_id, finished_at, error, cursor) say; a run with an error failed."""
    both = runs.join(ends.toDF("run_id", "_at", "_error", "_cursor"), "run_id", "left")
    status = F.when(F.col("_at").isNull(), F.col("status")).when(F.col("_error").isNotNull(), "failed").otherwise("completed")
    return both.select("run_id", "source_system", status.alias("status"), "started_at", F.coalesce("_at", "finished_at").alias("finished_at"), F.col("_error").alias("error"), F.when(F.col("_error").isNull(), F.col("_cursor")).alias("cursor"))
