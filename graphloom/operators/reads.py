"""Neighbours, details, timelines and lists, in batch form: many nodes at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..session import written


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str = "both", most: int | None = None, of: DataFrame | None = None, canonical_only: bool = False) -> DataFrame:
    """One hop: node_id, direction, relationship, other_id, name, node_type, confidence, weight.

    ``of`` (node_id) restricts the starts; ``most`` keeps so many by relationship and id for each node and direction. With
    ``canonical_only`` neighbours that are aliases of others are left out, before that.
    """
    legs = []
    for way, near, far in (("out", "source_id", "target_id"), ("in", "target_id", "source_id")):
        if direction in (way, "both"):
            leg = edges.select(F.col(near).alias("node_id"), F.lit(way).alias("direction"), "relationship", F.col(far).alias("other_id"), "confidence", "weight")
            legs.append(leg if of is None else leg.join(of, "node_id", "left_semi"))
    both = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
    if canonical_only:
        nodes = nodes.where("canonical_node_id is null")
        both = both.join(nodes.select(F.col("node_id").alias("other_id")), "other_id", "left_semi")
    if most is not None:
        order = Window.partitionBy("node_id", "direction").orderBy("relationship", "other_id")
        both = both.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    names = nodes.select(F.col("node_id").alias("other_id"), "name", "node_type")
    return both.join(names, "other_id").select("node_id", "direction", "relationship", "other_id", "name", "node_type", "confidence", "weight")


def degrees(edges: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """node_id, n_out, n_in: ends are counted before they meet. With ``visible`` (node_id) only edges count whose ends
    are both visible."""
    if visible is not None:
        for end in ("source_id", "target_id"):
            edges = edges.join(visible.select(F.col("node_id").alias(end)), end, "left_semi")
    out = edges.select(F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    both = out.unionByName(edges.select(F.col("target_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node_id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def node_sources(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    return mentions.select("node_id", "document_id").join(docs, "document_id")


def node_details(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, docs: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Attributes, degree and number of visible sources of each node. Degrees are scoped to ``visible`` nodes, if given."""
    sources = mentions.join(docs.select("document_id", "source_system"), "document_id").groupBy("node_id").agg(F.count(F.lit(1)).alias("n_sources"), F.array_sort(F.collect_set("source_system")).alias("systems"))
    zero = F.lit(0).cast("long")
    found = nodes.select("node_id", "node_type", "name").join(degrees(edges, visible), "node_id", "left").join(sources, "node_id", "left")
    return found.select("node_id", "node_type", "name", *(F.coalesce(c, zero).alias(c) for c in ("n_out", "n_in", "n_sources")), F.coalesce("systems", F.array().cast("array<string>")).alias("systems"))


def ranked(df: DataFrame, per: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of every group; the group limit acts before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("rank") <= most)


def wide_ranks(df: DataFrame, per: list[str], order: list[Column]) -> DataFrame:
    """All rows with their ``rank`` in groups of any size: ranges of the order are numbered side by side, and each
    starts after the rows of its group in the ranges before."""
    spread = written(df.repartitionByRange(*per, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy(*per, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*per).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(c).alias(f"_{c}") for c in per), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = spread.withColumn("rank", F.row_number().over(Window.partitionBy(*per, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_at")
    for c in per:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(starts, same).select(*df.columns, (F.col("rank") + F.col("_start")).alias("rank"))


def entity_timeline(mentions: DataFrame, docs: DataFrame, most: int = 20) -> DataFrame:
    """Newest documents of each node."""
    seen = mentions.select("node_id", "document_id").join(docs, "document_id")
    seen = seen.withColumn("ts", scores.timeline_ts(F.col("source_updated_at"), F.col("source_created_at"), F.col("ingested_at")))
    return ranked(seen, ["node_id"], [F.col("ts").desc_nulls_last(), F.col("document_id")], most).select("node_id", "rank", "document_id", "source_system", "ts")


def node_story(mentions: DataFrame, docs: DataFrame, most: int = 200) -> DataFrame:
    """Oldest mentions first, with a snippet; only of the documents given, so pass the visible ones."""
    seen = mentions.join(docs.drop("content"), "document_id")
    seen = seen.withColumn("ts", scores.story_ts(F.col("source_created_at"), F.col("ingested_at"), F.col("created_at")))
    return ranked(seen, ["node_id"], [F.col("source_created_at").asc_nulls_last(), F.col("ts"), F.col("document_id")], most).select("node_id", "rank", "document_id", "ts", F.substring("context", 1, 160).alias("snippet"))


def resolve_canonical(nodes: DataFrame, hops: int = 16) -> DataFrame:
    """node_id, root: where alias pointers lead within ``hops``, by doubling; in a cycle its smallest id."""
    ways = nodes.select("node_id", F.coalesce("canonical_node_id", "node_id").alias("to"), F.least("node_id", F.coalesce("canonical_node_id", "node_id")).alias("low"))
    for _ in range(max(1, (hops - 1).bit_length())):
        far = ways.select(F.col("node_id").alias("to"), F.col("to").alias("next"), F.col("low").alias("more"))
        ways = ways.join(far, "to", "left").select("node_id", F.coalesce("next", "to").alias("to"), F.least("low", F.coalesce("more", "low")).alias("low"))
    ends = nodes.where("canonical_node_id is null").select(F.col("node_id").alias("to"), F.lit(True).alias("end"))
    return ways.join(ends, "to", "left").select("node_id", F.when(F.col("end"), F.col("to")).otherwise(F.col("low")).alias("root"))
