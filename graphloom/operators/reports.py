"""Aggregates: statistics, health, metrics and the digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import visibility


def graph_stats(nodes: DataFrame, edges: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """section, label, value: canonical nodes by type and edges by relationship."""
    own = visibility.visible_nodes(nodes.where("canonical_node_id is null"), visible)
    by_type = own.groupBy(F.lit("nodes").alias("section"), F.col("node_type").alias("label")).agg(F.count(F.lit(1)).alias("value"))
    by_rel = visibility.visible_edges(edges, visible).groupBy(F.lit("edges").alias("section"), F.col("relationship").alias("label")).agg(F.count(F.lit(1)).alias("value"))
    return by_type.unionByName(by_rel)


def connector_health(runs: DataFrame, failing_at: float = 50.0) -> DataFrame:
    """Runs, failures, share, last end and last status of each source."""
    out = runs.groupBy("source_system").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.max("finished_at").alias("last_finished"),
        F.max_by("status", F.struct(F.col("finished_at").isNotNull(), "finished_at", "run_id")).alias("last_status"),
    )
    rate = F.when(F.col("n_runs") == 0, 0.0).otherwise(100.0 * F.col("n_failed") / F.col("n_runs"))
    return out.withColumn("failure_rate", F.round(rate, 6)).withColumn("failing", rate >= failing_at)


def last_completed(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'completed'").groupBy("source_system").agg(F.max("finished_at").alias("last_sync"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, docs: DataFrame, runs: DataFrame, proposals: DataFrame) -> DataFrame:
    """metric, label, value."""

    def total(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), F.lit("").alias("label"), "value")

    def by_status(name: str, df: DataFrame) -> DataFrame:
        return df.groupBy(F.lit(name).alias("metric"), F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("value"))

    out = total("nodes_total", nodes).unionByName(total("edges_total", edges)).unionByName(total("raw_documents_total", docs))
    return out.unionByName(by_status("ingestion_runs_total", runs)).unionByName(by_status("proposals_total", proposals))


def digest(runs: DataFrame, docs: DataFrame, nodes: DataFrame, proposals: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(section, position, line) of the last days' report."""
    since = now - F.expr(f"INTERVAL {days} DAYS")

    def lines(section: int, df: DataFrame, key: Column, text: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), key.alias("position"), text.alias("line"))

    n, none = F.col("n").cast("string"), F.lit("")
    by_run = runs.where(F.col("started_at") >= since).groupBy("source_system", "status").agg(F.count(F.lit(1)).alias("n"))
    out = lines(1, by_run, F.concat_ws(" ", "source_system", "status"), F.concat(F.col("source_system"), F.lit(": "), n, F.lit(" run(s) "), F.col("status")))
    fresh = docs.where(F.col("ingested_at") >= since).agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(lines(2, fresh, none, F.concat(F.lit("documents ingested: "), n)))
    made = nodes.where((F.col("created_at") >= since) & F.col("canonical_node_id").isNull()).agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(lines(3, made, none, F.concat(F.lit("entities created: "), n)))
    filed = proposals.where(F.col("created_at") >= since).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(lines(4, filed, F.col("kind"), F.concat(F.lit("filed "), n, F.lit(" "), F.col("kind"), F.lit(" proposal(s)"))))
    applied = proposals.where(F.col("status").isin("approved", "auto_applied") & (F.col("applied_at") >= since)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(lines(5, applied, F.col("kind"), F.concat(F.lit("applied "), n, F.lit(" "), F.col("kind"), F.lit(" proposal(s)"))))
    rejected = proposals.where((F.col("status") == "rejected") & (F.col("decided_at") >= since)).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    out = out.unionByName(lines(6, rejected, none, F.concat(F.lit("rejected "), n, F.lit(" proposal(s)"))))
    pending = proposals.where("status = 'pending'").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(lines(7, pending, none, F.concat(F.lit("pending review now: "), n)))
