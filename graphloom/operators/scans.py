"""Maintenance scans: rows of (kind, payload, confidence, agent, evidence, dedup_key) for the proposal queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from ..session import written
from . import resolve

SYSTEM_KEYS = ("stale", "stale_since", "importance", "embedding_model", "disputed")


def finding(kind: str, payload: dict[str, Column], confidence: Column, agent: str, key: Column, evidence: dict[str, Column] | None = None) -> list[Column]:
    def bag(d: dict[str, Column]) -> Column:
        return F.create_map(*(x for k, v in d.items() for x in (F.lit(k), v.cast("string")))) if d else F.create_map().cast("map<string,string>")

    return [F.lit(kind).alias("kind"), bag(payload).alias("payload"), confidence.alias("confidence"), F.lit(agent).alias("agent"), bag(evidence or {}).alias("evidence"), key.alias("dedup_key")]


def unfiled(rows: DataFrame, kind: str, filed: DataFrame | None, limit: int | None, order: list[str | Column], limit_before_filed: bool = False) -> DataFrame:
    """The first ``limit`` rows in ``order`` whose ``dedup_key`` the queue ``filed`` has under no status for this kind.

    Rows that were filed before take no room, unless ``limit_before_filed``, which limits first.
    """

    def fresh(df: DataFrame) -> DataFrame:
        if filed is None:
            return df
        known = filed.where((F.col("kind") == kind) & F.col("dedup_key").isNotNull()).select("dedup_key").distinct()
        return df.join(known, "dedup_key", "left_anti")

    def first(df: DataFrame) -> DataFrame:
        return df if limit is None else df.orderBy(*order).limit(limit)

    return fresh(first(rows)) if limit_before_filed else first(fresh(rows))


def quiet_nodes(mentions: DataFrame, docs: DataFrame, now: Column, after_days: int) -> DataFrame:
    """node_id, last_seen of nodes last mentioned before the cutoff."""
    fresh = scores.freshness_ts(F.col("source_updated_at"), F.col("ingested_at"), F.col("created_at"))
    last = mentions.select("node_id", "document_id").join(docs.select("document_id", fresh.alias("ts")), "document_id").groupBy("node_id").agg(F.max("ts").alias("last_seen"))
    return last.where(F.col("last_seen") < now - F.make_interval(days=F.lit(after_days)))


def scan_staleness(nodes: DataFrame, mentions: DataFrame, docs: DataFrame, now: Column, after_days: int = 180, limit: int | None = 200, filed: DataFrame | None = None, limit_before_filed: bool = False) -> DataFrame:
    own = nodes.where(F.col("canonical_node_id").isNull() & ~scores.flagged(F.col("properties"), "stale")).select("node_id", "name")
    quiet = quiet_nodes(mentions, docs, now, after_days).join(own, "node_id").withColumn("age", scores.age_days(now, F.col("last_seen"))).withColumn("day", F.date_format("last_seen", "yyyy-MM-dd"))
    quiet = unfiled(quiet.withColumn("dedup_key", F.concat_ws(":", "node_id", "day")), "stale_flag", filed, limit, ["last_seen", "node_id"], limit_before_filed)
    reason = F.concat(F.lit("no evidence for '"), "name", F.lit("' in "), F.col("age").cast("string"), F.lit(" days"))
    return quiet.select(*finding("stale_flag", {"node_id": F.col("node_id"), "last_seen": F.col("day"), "reason": reason}, scores.stale_confidence(F.col("age"), after_days), "staleness", F.col("dedup_key"), {"age_days": F.col("age")}))


def orphans(nodes: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Canonical nodes without an edge at either end, a mention, or an alias.

    Nodes and what uses them are one union, summed up before it moves; so every table is read once. (An anti join of
    nodes with their uses would be done again for each table that the nodes come from.)
    """
    own = nodes.where("canonical_node_id is null")
    uses = [edges.select(F.col("source_id").alias("node_id")), edges.select(F.col("target_id").alias("node_id")), mentions.select("node_id"), nodes.where("canonical_node_id is not null").select(F.col("canonical_node_id").alias("node_id"))]
    seen = own.select("node_id", F.lit(0).alias("used"))
    for df in uses:
        seen = seen.unionByName(df.select("node_id", F.lit(1).alias("used")))
    ids = seen.groupBy("node_id").agg(F.max("used").alias("used")).where("used = 0").select("node_id")
    return own.join(written(ids, "orphans"), "node_id", "left_semi")


def scan_orphans(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, limit: int | None = 100, filed: DataFrame | None = None, limit_before_filed: bool = False) -> DataFrame:
    found = orphans(nodes, edges, mentions).select("node_id", "name", F.col("node_id").alias("dedup_key"))
    found = unfiled(found, "node_removal", filed, limit, ["node_id"], limit_before_filed)
    return found.select(*finding("node_removal", {"node_id": F.col("node_id"), "name": F.col("name")}, F.lit(0.7), "hygiene", F.col("dedup_key")))


def scan_weak_edges(edges: DataFrame, below: float = 0.3, limit: int | None = 100, filed: DataFrame | None = None, limit_before_filed: bool = False) -> DataFrame:
    found = edges.where((F.col("confidence") < below) & F.col("evidence_document_id").isNull()).withColumn("dedup_key", F.concat_ws(":", "source_id", "relationship", "target_id"))
    found = unfiled(found, "edge_removal", filed, limit, ["confidence", "source_id", "target_id", "relationship"], limit_before_filed)
    return found.select(*finding("edge_removal", {c: F.col(c) for c in ("source_id", "target_id", "relationship")}, F.lit(0.6), "hygiene", F.col("dedup_key")))


def scan_contradictions(nodes: DataFrame, limit: int | None = 100, filed: DataFrame | None = None, limit_before_filed: bool = False) -> DataFrame:
    """Properties in which an alias differs from its canonical node; system keys and disputed ones are left out.

    ``limit`` takes pairs in order of the canonical name, of those that have something to file. Values are compared as JSON scalars: 1 and 1.0 are equal,
    "1" and 1 are not.
    """
    a = nodes.where("canonical_node_id is not null").select(F.col("node_id").alias("alias_id"), F.col("canonical_node_id").alias("node_id"), F.col("properties").alias("p"))
    pairs = a.join(nodes.select("node_id", "name", F.col("properties").alias("q")), "node_id")
    first = ["name", "node_id", "alias_id"]
    if limit is not None and limit_before_filed:
        pairs = pairs.orderBy(*first).limit(limit)
    rows = pairs.select("node_id", "alias_id", "name", "q", F.explode("p").alias("key", "alias_value")).withColumn("value", F.try_element_at("q", F.col("key")))
    rows = rows.where(F.col("value").isNotNull() & ~F.col("key").isin(*SYSTEM_KEYS) & F.try_element_at("q", F.concat(F.lit("disputed."), "key")).isNull())
    scalar = F.coalesce(scores.scalar_equal(F.try_parse_json("value"), F.try_parse_json("alias_value")), F.col("value") == F.col("alias_value"))
    rows = unfiled(rows.where(~scalar).withColumn("dedup_key", F.concat_ws(":", "node_id", "alias_id", "key")), "fact_conflict", filed, None, [])
    if limit is not None and not limit_before_filed:
        rows = written(rows, "conflicts")
        rows = rows.join(rows.select(*first).distinct().orderBy(*first).limit(limit).select("node_id", "alias_id"), ["node_id", "alias_id"], "left_semi")
    return rows.select(*finding("fact_conflict", {c: F.col(c) for c in ("node_id", "alias_id", "key", "value", "alias_value")}, F.lit(0.6), "contradiction", F.col("dedup_key")))


def fuzzy_pairs(nodes: DataFrame, name_at: float, vectors: DataFrame | None = None, near: float = 0.25) -> DataFrame:
    """a, b, name_similarity, distance of canonical nodes of one type, not both of one source, similar by name or
    vector. Both scores are given for every pair that has them."""
    own = nodes.where("canonical_node_id is null").select("node_id", "node_type", "name", "source_system")
    same = own.select("node_type", "name").distinct().select("node_type", F.col("name").alias("a"), F.col("name").alias("b"))
    names = resolve.name_pairs(own, name_at).select("node_type", "a", "b").unionByName(same)
    # nodes of one name and source are a class: classes that can't pair never meet as nodes
    classes = own.select("node_type", "name", "source_system").distinct()
    x, y = classes.toDF("node_type", "a", "s"), classes.toDF("node_type", "b", "t")
    apart = F.col("s").isNull() | F.col("t").isNull() | (F.col("s") != F.col("t"))
    met = names.join(x, ["node_type", "a"]).join(y, ["node_type", "b"]).where(apart)
    i, j = own.toDF("i", "node_type", "a", "s").alias("i"), own.toDF("j", "node_type", "b", "t").alias("j")
    left = met.alias("m").join(i, (F.col("m.node_type") == F.col("i.node_type")) & (F.col("m.a") == F.col("i.a")) & F.col("m.s").eqNullSafe(F.col("i.s"))).select("m.node_type", "m.b", "m.t", "i")
    by_name = left.alias("m").join(j, (F.col("m.node_type") == F.col("j.node_type")) & (F.col("m.b") == F.col("j.b")) & F.col("m.t").eqNullSafe(F.col("j.t"))).where("i <> j")
    pairs = by_name.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    if vectors is not None:
        close = resolve.vector_pairs(vectors.join(own.select("node_id"), "node_id", "left_semi"), near, same_type=True).select("a", "b")
        of = own.select("node_id", "source_system")
        close = close.join(of.toDF("a", "s"), "a").join(of.toDF("b", "t"), "b").where(apart).select("a", "b")
        pairs = pairs.unionByName(close).distinct()
    n = own.select("node_id", "name")
    out = pairs.join(n.toDF("a", "_x"), "a").join(n.toDF("b", "_y"), "b").withColumn("name_similarity", text.trigram_similarity(F.col("_x"), F.col("_y"))).drop("_x", "_y")
    if vectors is None:
        return out.withColumn("distance", F.lit(None).cast("double"))
    v = vectors.select("node_id", "embedding")
    out = out.join(v.toDF("a", "_x"), "a", "left").join(v.toDF("b", "_y"), "b", "left")
    return out.withColumn("distance", scores.cosine_distance(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def pick_winner(pairs: DataFrame, nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """winner_id, loser_id: sourced before derived, then more mentions, then older, then the smaller id."""
    count = mentions.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    rank = nodes.join(count, "node_id", "left").select("node_id", F.struct(F.col("external_id").isNull().alias("derived"), (-F.coalesce("n", F.lit(0))).alias("few"), F.coalesce("created_at", F.lit("9999-01-01").cast("timestamp")).alias("since"), "node_id").alias("r"))
    both = pairs.join(rank.toDF("a", "ra"), "a").join(rank.toDF("b", "rb"), "b")
    first = F.col("ra") <= F.col("rb")
    return both.withColumn("winner_id", F.when(first, F.col("a")).otherwise(F.col("b"))).withColumn("loser_id", F.when(first, F.col("b")).otherwise(F.col("a"))).drop("ra", "rb")


def scan_dedup(nodes: DataFrame, mentions: DataFrame, vectors: DataFrame | None = None, name_at: float = 0.45, near: float = 0.25, limit: int | None = 100, judgments: DataFrame | None = None, filed: DataFrame | None = None, limit_before_filed: bool = False) -> DataFrame:
    """Merge proposals. ``judgments`` (dedup_key, verdict, judged) may raise, lower or, from 0.8 on, drop a pair."""
    pairs = fuzzy_pairs(nodes, name_at, vectors, near).withColumn("dedup_key", text.pair_key(F.col("a"), F.col("b")))
    pairs = unfiled(pairs, "entity_merge", filed, limit, [F.col("name_similarity").desc_nulls_last(), F.col("a"), F.col("b")], limit_before_filed)
    pairs = pick_winner(pairs, nodes, mentions).withColumn("score", scores.blend_confidence(F.col("name_similarity"), F.col("distance")))
    if judgments is not None:
        pairs = pairs.join(judgments, "dedup_key", "left").where("verdict is null or not (verdict = 'different' and judged >= 0.8)")
        pairs = pairs.withColumn("score", scores.judge_confidence(F.col("score"), F.col("verdict"), F.col("judged")))
    return pairs.select(*finding("entity_merge", {"winner_id": F.col("winner_id"), "loser_id": F.col("loser_id")}, F.col("score"), "dedup", F.col("dedup_key"), {"name_similarity": F.round("name_similarity", 6), "distance": F.round("distance", 6)}))


def link_candidates(vectors: DataFrame, mentions: DataFrame, edges: DataFrame, near: float, least_mentions: int = 2, places: int = 12) -> DataFrame:
    """a, b, distance of nodes mentioned often enough, close by vector, without an edge either way. Distances are rounded
    to ``places`` before they are compared."""
    often = mentions.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_mentions)
    pairs = resolve.vector_pairs(vectors.join(often, "node_id", "left_semi"), near, places=places)
    known = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def scan_link_prediction(vectors: DataFrame, mentions: DataFrame, edges: DataFrame, suggestions: DataFrame, registry: DataFrame, near: float = 0.2, limit: int | None = 50, filed: DataFrame | None = None, limit_before_filed: bool = False, places: int = 12) -> DataFrame:
    """``suggestions`` (dedup_key, relationship, judged) of a judge; known relationships of at least 0.5 are filed."""
    pairs = link_candidates(vectors, mentions, edges, near, places=places).withColumn("dedup_key", text.pair_key(F.col("a"), F.col("b")))
    pairs = unfiled(pairs, "edge_add", filed, limit, ["distance", "a", "b"], limit_before_filed)
    pairs = pairs.join(suggestions, "dedup_key").where("judged >= 0.5").join(registry.select("relationship"), "relationship", "left_semi")
    return pairs.select(*finding("edge_add", {"source_id": F.col("a"), "target_id": F.col("b"), "relationship": F.col("relationship")}, F.col("judged"), "edge_suggest", F.col("dedup_key"), {"distance": F.round("distance", 6)}))
