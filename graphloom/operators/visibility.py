"""Row-level visibility: grants to documents, documents to nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grants_for(grants: DataFrame, groups: list[str]) -> DataFrame:
    """(source_system, everything, keys) that some groups hold together; everything absorbs single keys."""
    own = grants.where(F.col("group_name").isin(groups))
    out = own.groupBy("source_system").agg(F.bool_or(F.col("resource_key").isNull()).alias("everything"), F.array_sort(F.collect_set("resource_key")).alias("keys"))
    return out.withColumn("keys", F.when(F.col("everything"), F.array().cast("array<string>")).otherwise(F.col("keys")))


def visible_documents(docs: DataFrame, grants: DataFrame, groups: list[str]) -> DataFrame:
    """Documents of a source granted whole, or of a granted resource. Without grants, none."""
    held = grants_for(grants, groups)
    whole = held.where("everything").select("source_system")
    single = held.where("not everything").select("source_system", F.explode("keys").alias("resource_key"))
    return docs.join(whole, "source_system", "left_semi").unionByName(docs.join(single, ["source_system", "resource_key"], "left_semi").select(docs.columns))


def visible_node_ids(mentions: DataFrame, docs: DataFrame, grants: DataFrame, groups: list[str]) -> DataFrame:
    """Nodes that some visible document mentions."""
    return mentions.join(visible_documents(docs, grants, groups), "document_id", "left_semi").select("node_id").distinct()


def visible_nodes(nodes: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Nodes among visible ids; all of them for a superuser (None)."""
    return nodes if ids is None else nodes.join(ids, "node_id", "left_semi")


def visible_edges(edges: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Edges whose ends are both visible."""
    if ids is None:
        return edges
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.select(F.col("node_id").alias(end)), end, "left_semi")
    return edges
