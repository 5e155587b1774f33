"""Filters, joins, aggregates, windows, top-k and set operations over the lens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..lens import Lens
from ..operators import reads, reports, visibility
from ..session import written
from .registry import query

SINCE = "2024-01-25 00:00:00"


def proposals(g: Lens) -> DataFrame:
    """A queue derived from events: kind, status, confidence and times of 1,000s of proposals."""
    e = g.table("events")
    kind = F.element_at(F.array(*map(F.lit, ("entity_merge", "stale_flag", "edge_add", "node_removal"))), (F.col("event_id") % 4 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, ("pending", "approved", "rejected", "auto_applied", "failed"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("proposal:"), F.col("event_id")).alias("proposal_id"), kind.alias("kind"), status.alias("status"), F.round(F.col("event_id") % 97 / 97, 4).alias("confidence"), F.col("ts").alias("created_at"),
        F.when(status != "pending", F.col("ts")).alias("decided_at"), F.when(status.isin("approved", "auto_applied"), F.col("ts")).alias("applied_at"), F.concat(F.lit("customer:"), F.col("user_id")).alias("node_id"), F.concat_ws(":", kind, F.col("user_id")).alias("dedup_key"), F.col("event_type").alias("agent"),
    )


PROPOSALS = """, proposals AS (SELECT 'proposal:' || event_id AS proposal_id, ['entity_merge','stale_flag','edge_add','node_removal'][event_id % 4 + 1] AS kind,
 ['pending','approved','rejected','auto_applied','failed'][event_id % 5 + 1] AS status, round((event_id % 97)::DOUBLE / 97, 4) AS confidence, ts AS created_at,
 CASE WHEN event_id % 5 <> 0 THEN ts END AS decided_at, CASE WHEN event_id % 5 IN (1, 3) THEN ts END AS applied_at, 'customer:' || user_id AS node_id,
 ['entity_merge','stale_flag','edge_add','node_removal'][event_id % 4 + 1] || ':' || user_id AS dedup_key, event_type AS agent FROM events)
"""
_SALES = ["sales"]

# --- projections, filters, predicates


@query("SELECT node_id, name FROM n_part WHERE canonical_node_id IS NULL")
def filter_canonical(g: Lens) -> DataFrame:
    return g.parts.where("canonical_node_id is null").select("node_id", "name")


@query("SELECT node_id, name FROM nodes WHERE node_type = 'supplier'")
def filter_node_type(g: Lens) -> DataFrame:
    return g.nodes().where("node_type = 'supplier'").select("node_id", "name")


@query("SELECT 'vec:' || vec_id AS node_id FROM embeddings WHERE embedding IS NOT NULL")
def filter_has_embedding(g: Lens) -> DataFrame:
    return g.vectors.where("embedding is not null").select("node_id")


@query("SELECT 'customer:' || c_custkey AS node_id FROM customer WHERE c_acctbal < 0")
def filter_stale_flag(g: Lens) -> DataFrame:
    return g.nodes("customer").where(scores.flagged(F.col("properties"), "stale")).select("node_id")


@query(f"SELECT document_id, ingested_at FROM event_docs WHERE ingested_at >= TIMESTAMP '{SINCE}'")
def filter_since(g: Lens) -> DataFrame:
    return g.event_docs.where(F.col("ingested_at") >= F.lit(SINCE).cast("timestamp")).select("document_id", "ingested_at")


def by_status_kind(queue: DataFrame, status: str = "all", kind: str = "all") -> DataFrame:
    for name, value in (("status", status), ("kind", kind)):
        queue = queue if value == "all" else queue.where(F.col(name) == value)
    return queue


@query(PROPOSALS + "SELECT proposal_id, confidence FROM proposals WHERE status = 'pending' AND kind = 'stale_flag'")
def filter_status_kind(g: Lens) -> DataFrame:
    return by_status_kind(proposals(g), "pending", "stale_flag").select("proposal_id", "confidence")


def by_id_prefix(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """prefix, n_matches, the id if exactly one matches, else an error."""
    found = requests.join(rows, F.col("proposal_id").startswith(F.col("prefix")), "left").groupBy("prefix").agg(F.count("proposal_id").alias("n_matches"), F.min("proposal_id").alias("only"))
    return found.select("prefix", "n_matches", F.when(F.col("n_matches") == 1, F.col("only")).alias("proposal_id"), F.when(F.col("n_matches") == 0, "no match").when(F.col("n_matches") > 1, "ambiguous").alias("error"))


@query(PROPOSALS + """SELECT prefix, count(proposal_id) AS n_matches, CASE WHEN count(proposal_id) = 1 THEN min(proposal_id) END AS proposal_id,
 CASE WHEN count(proposal_id) = 0 THEN 'no match' WHEN count(proposal_id) > 1 THEN 'ambiguous' END AS error
 FROM (VALUES ('proposal:999'), ('proposal:77'), ('proposal:x')) v(prefix) LEFT JOIN proposals ON starts_with(proposal_id, prefix) GROUP BY prefix""")
def filter_id_prefix(g: Lens) -> DataFrame:
    asked = g.spark.createDataFrame([("proposal:999",), ("proposal:77",), ("proposal:x",)], "prefix string")
    return by_id_prefix(proposals(g).select("proposal_id"), F.broadcast(asked))


def changed_documents(docs: DataFrame, force: bool = False) -> DataFrame:
    """Documents whose content differs from what was extracted; all of them if forced."""
    same = F.col("content_hash").isNotNull() & F.col("content_hash").eqNullSafe(F.col("extracted_hash"))
    return docs if force else docs.where(~same)


@query("SELECT 'document:' || doc_id AS document_id FROM documents WHERE text IS NULL OR text = '' OR doc_id % 3 <> 0")
def filter_unchanged_docs(g: Lens) -> DataFrame:
    docs = g.text_docs.withColumn("content_hash", text.content_hash(F.col("content")))
    docs = docs.withColumn("extracted_hash", F.when(F.col("external_id").cast("long") % 3 == 0, F.col("content_hash")))
    return changed_documents(docs).select("document_id")


@query("SELECT document_id, source_system, resource_key FROM event_docs WHERE source_system IN ('click', 'view') OR (source_system = 'purchase' AND resource_key IN ('1', '2', '3'))")
def filter_in_grants(g: Lens) -> DataFrame:
    return visibility.visible_documents(g.event_docs, g.grants, ["eng", "sales"]).select("document_id", "source_system", "resource_key")


@query("SELECT document_id, source_updated_at AS fresh, source_updated_at AS shown, ingested_at AS told FROM event_docs")
def project_source_fallbacks(g: Lens) -> DataFrame:
    c = {k: F.col(k) for k in ("source_updated_at", "source_created_at", "ingested_at", "created_at")}
    fresh, shown, told = scores.freshness_ts(c["source_updated_at"], c["ingested_at"], c["created_at"]), scores.timeline_ts(c["source_updated_at"], c["source_created_at"], c["ingested_at"]), scores.story_ts(c["source_created_at"], c["ingested_at"], c["created_at"])
    return g.event_docs.select("document_id", fresh.alias("fresh"), shown.alias("shown"), told.alias("told"))


# --- joins


@query("SELECT node_id, document_id, source_system FROM mentions JOIN event_docs USING (document_id)")
def join_node_sources(g: Lens) -> DataFrame:
    return reads.node_sources(g.mentions, g.event_docs).select("node_id", "document_id", "source_system")


_NEAR = "SELECT {a} AS node_id, relationship, {b} AS other_id, name, node_type, confidence, weight FROM (SELECT * FROM e_member_of UNION ALL SELECT * FROM e_part_of) e JOIN nodes n ON n.node_id = e.{b}"


@query(_NEAR.format(a="source_id", b="target_id"))
def join_neighbors_out(g: Lens) -> DataFrame:
    return reads.neighbors(g.edges("MEMBER_OF", "PART_OF"), g.nodes("region", "nation"), "out").drop("direction")


@query(_NEAR.format(a="target_id", b="source_id"))
def join_neighbors_in(g: Lens) -> DataFrame:
    return reads.neighbors(g.edges("MEMBER_OF", "PART_OF"), g.nodes("nation", "customer", "supplier"), "in").drop("direction")


@query("SELECT node_id, document_id, source_updated_at AS ts FROM mentions JOIN visible_docs USING (document_id)")
def join_mention_doc_timeline(g: Lens) -> DataFrame:
    docs = visibility.visible_documents(g.event_docs, g.grants, _SALES)
    return g.mentions.join(docs, "document_id").select("node_id", "document_id", F.col("source_updated_at").alias("ts"))


@query("SELECT node_id, name FROM n_customer SEMI JOIN visible USING (node_id)")
def semi_visible_nodes(g: Lens) -> DataFrame:
    ids = visibility.visible_node_ids(g.mentions, g.event_docs, g.grants, _SALES)
    return visibility.visible_nodes(g.nodes("customer"), ids).select("node_id", "name")


@query("SELECT a.node_id AS source_id, b.node_id AS target_id FROM visible a JOIN visible b ON a.node_id <> b.node_id JOIN customer x ON 'customer:' || x.c_custkey = a.node_id JOIN customer y ON 'customer:' || y.c_custkey = b.node_id WHERE y.c_custkey = x.c_custkey + 1")
def semi_edges_both_visible(g: Lens) -> DataFrame:
    c = g.table("customer")
    chain = c.select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("source_id"), F.concat(F.lit("customer:"), F.col("c_custkey") + 1).alias("target_id"))
    return visibility.visible_edges(chain, visibility.visible_node_ids(g.mentions, g.event_docs, g.grants, _SALES))


@query("SELECT n.node_id AS canonical_id, a.node_id AS alias_id FROM n_part a JOIN n_part n ON a.canonical_node_id = n.node_id")
def join_alias_canonical(g: Lens) -> DataFrame:
    a = g.parts.where("canonical_node_id is not null").select(F.col("node_id").alias("alias_id"), F.col("canonical_node_id").alias("canonical_id"))
    return a.join(g.parts.select(F.col("node_id").alias("canonical_id")), "canonical_id").select("canonical_id", "alias_id")


def not_filed(found: DataFrame, queue: DataFrame) -> DataFrame:
    """Findings whose (kind, dedup_key) no proposal of any status has; null keys always pass."""
    filed = queue.where("dedup_key is not null").select("kind", "dedup_key").distinct()
    return found.join(filed, ["kind", "dedup_key"], "left_anti")


@query(PROPOSALS + "SELECT 'stale_flag' AS kind, 'stale_flag:' || c_custkey AS dedup_key FROM customer WHERE 'stale_flag:' || c_custkey NOT IN (SELECT dedup_key FROM proposals)")
def anti_already_filed(g: Lens) -> DataFrame:
    found = g.table("customer").select(F.lit("stale_flag").alias("kind"), F.concat(F.lit("stale_flag:"), F.col("c_custkey")).alias("dedup_key"))
    return not_filed(found, proposals(g)).select("kind", "dedup_key")


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: near, far, step (> or < and the relationship)."""
    out = edges.select(F.col("source_id").alias("near"), F.col("target_id").alias("far"), F.concat(F.lit(">"), "relationship").alias("step"))
    return out.unionByName(edges.select(F.col("target_id").alias("near"), F.col("source_id").alias("far"), F.concat(F.lit("<"), "relationship").alias("step")))


@query("SELECT source_id AS near, target_id AS far, '>' || relationship AS step FROM e_part_of UNION ALL SELECT target_id, source_id, '<' || relationship FROM e_part_of")
def join_lateral_adjacent(g: Lens) -> DataFrame:
    return adjacency(g.edges("PART_OF"))


def match_pattern(edges: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Distinct chains n0, n1, ...; each step is a relationship and its direction, > or <."""
    chain = None
    for k, (rel, way) in enumerate(steps):
        ends = ("source_id", "target_id") if way == ">" else ("target_id", "source_id")
        hop = edges.where(F.col("relationship") == rel).select(F.col(ends[0]).alias(f"n{k}"), F.col(ends[1]).alias(f"n{k + 1}"))
        chain = hop if chain is None else chain.join(hop, f"n{k}")
    return chain.select(*(f"n{k}" for k in range(len(steps) + 1))).distinct()


@query("SELECT DISTINCT r.target_id AS n0, n.source_id AS n1, c.source_id AS n2, o.target_id AS n3 FROM e_part_of r JOIN e_part_of n ON n.target_id = r.target_id JOIN e_member_of c ON c.target_id = n.source_id JOIN e_authored o ON o.source_id = c.source_id")
def join_multi_hop_pattern(g: Lens) -> DataFrame:
    return match_pattern(g.edges("PART_OF", "MEMBER_OF", "AUTHORED"), [("PART_OF", "<"), ("MEMBER_OF", "<"), ("AUTHORED", ">")])


@query("SELECT everything, keys, source_system FROM (SELECT source_system, bool_or(resource_key IS NULL) AS everything, CASE WHEN bool_or(resource_key IS NULL) THEN [] ELSE list_sort(list(resource_key)) END AS keys FROM grants GROUP BY 1)")
def join_grants_groups(g: Lens) -> DataFrame:
    return visibility.grants_for(g.grants, ["eng", "sales"])


# --- aggregates


@query("SELECT node_type, count(*) AS n_nodes FROM nodes WHERE canonical_node_id IS NULL GROUP BY 1")
def agg_nodes_by_type(g: Lens) -> DataFrame:
    return g.nodes().where("canonical_node_id is null").groupBy("node_type").agg(F.count(F.lit(1)).alias("n_nodes")).orderBy(F.desc("n_nodes"))


@query("SELECT relationship, count(*) AS n_edges FROM edges GROUP BY 1")
def agg_edges_by_rel(g: Lens) -> DataFrame:
    return g.edges().groupBy("relationship").agg(F.count(F.lit(1)).alias("n_edges")).orderBy(F.desc("n_edges"))


@query("SELECT count(*) AS n_stale FROM customer WHERE c_acctbal < 0")
def agg_stale_count(g: Lens) -> DataFrame:
    return g.nodes("customer").agg(F.count_if(scores.flagged(F.col("properties"), "stale")).alias("n_stale"))


@query("SELECT node_id, count(*) FILTER (WHERE o) AS n_out, count(*) FILTER (WHERE NOT o) AS n_in FROM (SELECT source_id AS node_id, true AS o FROM edges UNION ALL SELECT target_id, false FROM edges) GROUP BY 1")
def agg_degree(g: Lens) -> DataFrame:
    return reads.degrees(g.edges())


@query("SELECT node_id, count(*) AS n_mentions FROM mentions GROUP BY 1")
def agg_mentions_per_node(g: Lens) -> DataFrame:
    return g.mentions.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_mentions"))


@query("SELECT node_id, max(source_updated_at) AS last_seen FROM mentions JOIN event_docs USING (document_id) WHERE source_system = 'purchase' GROUP BY 1 HAVING max(source_updated_at) < TIMESTAMP '2024-01-29'")
def agg_freshness_having(g: Lens) -> DataFrame:
    from ..operators.scans import quiet_nodes

    docs = g.event_docs.where("source_system = 'purchase'")
    return quiet_nodes(g.mentions, docs, g.now, 3)


@query(f"SELECT source_system, status, count(*) AS n_runs FROM runs WHERE started_at >= TIMESTAMP '{SINCE}' GROUP BY 1, 2")
def agg_runs_by_source_status(g: Lens) -> DataFrame:
    return g.runs.where(F.col("started_at") >= F.lit(SINCE).cast("timestamp")).groupBy("source_system", "status").agg(F.count(F.lit(1)).alias("n_runs"))


@query(PROPOSALS + f"SELECT kind, count(*) AS n FROM proposals WHERE created_at >= TIMESTAMP '{SINCE}' GROUP BY 1")
def agg_proposals_filed(g: Lens) -> DataFrame:
    return proposals(g).where(F.col("created_at") >= F.lit(SINCE).cast("timestamp")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(PROPOSALS + f"SELECT kind, count(*) AS n FROM proposals WHERE status IN ('approved', 'auto_applied') AND applied_at >= TIMESTAMP '{SINCE}' GROUP BY 1")
def agg_proposals_applied(g: Lens) -> DataFrame:
    return proposals(g).where(F.col("status").isin("approved", "auto_applied") & (F.col("applied_at") >= F.lit(SINCE).cast("timestamp"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(PROPOSALS + f"SELECT count(*) AS n_rejected FROM proposals WHERE status = 'rejected' AND decided_at >= TIMESTAMP '{SINCE}'")
def agg_rejected(g: Lens) -> DataFrame:
    return proposals(g).agg(F.count_if((F.col("status") == "rejected") & (F.col("decided_at") >= F.lit(SINCE).cast("timestamp"))).alias("n_rejected"))


@query(PROPOSALS + "SELECT count(*) AS n_pending FROM proposals WHERE status = 'pending'")
def agg_pending(g: Lens) -> DataFrame:
    return proposals(g).agg(F.count_if(F.col("status") == "pending").alias("n_pending"))


@query(f"SELECT count(*) AS n_docs FROM event_docs WHERE ingested_at >= TIMESTAMP '{SINCE}'")
def agg_docs_since(g: Lens) -> DataFrame:
    return g.event_docs.where(F.col("ingested_at") >= F.lit(SINCE).cast("timestamp")).agg(F.count(F.lit(1)).alias("n_docs"))


@query("SELECT count(*) AS n_nodes FROM n_order WHERE created_at >= TIMESTAMP '1997-01-01'")
def agg_nodes_since(g: Lens) -> DataFrame:
    return g.nodes("order").where("canonical_node_id is null and created_at >= timestamp'1997-01-01'").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(PROPOSALS + "SELECT status, count(*) AS n FROM proposals GROUP BY 1")
def agg_proposals_by_status(g: Lens) -> DataFrame:
    return proposals(g).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_system, max(finished_at) AS last_sync FROM runs WHERE status = 'completed' GROUP BY 1")
def agg_last_completed_sync(g: Lens) -> DataFrame:
    return reports.last_completed(g.runs)


_HEALTH = """SELECT source_system, count(*) AS n_runs, count(*) FILTER (WHERE status = 'failed') AS n_failed, max(finished_at) AS last_finished,
 arg_max(status, (finished_at, run_id)) AS last_status, round(100.0 * count(*) FILTER (WHERE status = 'failed') / count(*), 6)::DOUBLE AS failure_rate,
 100.0 * count(*) FILTER (WHERE status = 'failed') / count(*) >= 50 AS failing FROM runs GROUP BY 1"""


@query(_HEALTH)
def agg_connector_health(g: Lens) -> DataFrame:
    return reports.connector_health(g.runs)


@query(PROPOSALS + """SELECT 'nodes_total' AS metric, '' AS label, count(*) AS value FROM nodes UNION ALL SELECT 'edges_total', '', count(*) FROM edges
 UNION ALL SELECT 'raw_documents_total', '', count(*) FROM event_docs UNION ALL SELECT 'ingestion_runs_total', status, count(*) FROM runs GROUP BY 2
 UNION ALL SELECT 'proposals_total', status, count(*) FROM proposals GROUP BY 2""")
def agg_graph_metrics(g: Lens) -> DataFrame:
    return reports.graph_metrics(g.nodes(), g.edges(), g.event_docs, g.runs, proposals(g))


@query("SELECT coalesce(list_sort(list(DISTINCT source_system) FILTER (WHERE resource_key IS NULL)), []) AS whole, coalesce(list_sort(list(DISTINCT source_system || '/' || resource_key) FILTER (WHERE resource_key IS NOT NULL)), []) AS single FROM grants")
def agg_grant_union(g: Lens) -> DataFrame:
    held = visibility.grants_for(g.grants, ["eng", "sales"])
    pairs = held.select("source_system", "everything", F.explode_outer("keys").alias("key"))
    return pairs.agg(F.array_sort(F.collect_set(F.when(F.col("everything"), F.col("source_system")))).alias("whole"), F.array_sort(F.collect_set(F.when(~F.col("everything"), F.concat_ws("/", "source_system", "key")))).alias("single"))


@query("SELECT 'part:' || l_partkey AS source_id, 'supplier:' || l_suppkey AS target_id, 'DEPENDS_ON' AS relationship, count(*)::DOUBLE AS weight, max(round(1 - l_tax, 6)) AS confidence, arg_max('order:' || l_orderkey, (l_orderkey, l_linenumber)) AS evidence_document_id FROM lineitem GROUP BY ALL")
def agg_edge_fold(g: Lens) -> DataFrame:
    from ..operators.resolve import fold_edges

    li = g.table("lineitem")
    seen = li.select(F.concat(F.lit("part:"), F.col("l_partkey")).alias("source_id"), F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("target_id"), F.lit("DEPENDS_ON").alias("relationship"), F.round(1 - F.col("l_tax"), 6).alias("confidence"), F.create_map().cast("map<string,string>").alias("properties"), F.concat(F.lit("order:"), F.col("l_orderkey")).alias("evidence_document_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return fold_edges(seen).drop("properties")


@query("SELECT 'customer' AS node_type, event_type AS source_system, user_id::VARCHAR AS external_id, arg_max('event ' || event_id, event_id) AS name, max(round(value / 1000, 6)) AS confidence, json_extract_string(arg_max(props, event_id), '$.k') AS k FROM events GROUP BY ALL")
def agg_node_fold(g: Lens) -> DataFrame:
    from ..operators.resolve import fold_nodes

    e = g.table("events")
    seen = e.select(F.lit("customer").alias("node_type"), F.col("event_type").alias("source_system"), F.col("user_id").cast("string").alias("external_id"), F.concat(F.lit("event "), F.col("event_id")).alias("name"), F.lit(None).cast("string").alias("summary"), F.from_json("props", "map<string,string>").alias("properties"), F.round(F.col("value") / 1000, 6).alias("confidence"), F.col("event_id").alias("seq"))
    return fold_nodes(seen).select("node_type", "source_system", "external_id", "name", "confidence", F.try_element_at("properties", F.lit("k")).alias("k"))


@query("SELECT count(*) AS n_documents, count(*) FILTER (WHERE doc_id % 3 = 0 AND text <> '') AS n_unchanged, sum(n_chars) FILTER (WHERE NOT (doc_id % 3 = 0 AND text <> ''))::BIGINT AS chars_extracted FROM documents")
def agg_pipeline_report(g: Lens) -> DataFrame:
    d = g.table("documents")
    same = (F.col("doc_id") % 3 == 0) & (F.coalesce("text", F.lit("")) != "")
    return d.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(same).alias("n_unchanged"), F.sum(F.when(~same, F.col("n_chars"))).alias("chars_extracted"))


@query("SELECT source_id, count(*) AS n_links, list_sort(list(target_id)) AS targets FROM e_links GROUP BY 1")
def agg_demo_summary(g: Lens) -> DataFrame:
    return g.edges("LINKS").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_links"), F.array_sort(F.collect_list("target_id")).alias("targets"))


@query(PROPOSALS + "SELECT agent, count(*) AS n_filed FROM proposals GROUP BY 1")
def agg_agent_report(g: Lens) -> DataFrame:
    return proposals(g).groupBy("agent").agg(F.count(F.lit(1)).alias("n_filed"))


# --- windows


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def win_latest_document(g: Lens) -> DataFrame:
    return reads.ranked(g.table("events"), ["event_type", "user_id"], [F.col("event_id").desc()], 1).select("event_type", "user_id", "event_id")


@query("SELECT source_system, arg_max(status, (finished_at, run_id)) AS last_status FROM runs GROUP BY 1")
def win_last_status(g: Lens) -> DataFrame:
    return reports.connector_health(g.runs).select("source_system", "last_status")


@query("SELECT node_id, document_id FROM (SELECT m.*, row_number() OVER (PARTITION BY node_id, source_system ORDER BY event_id) AS n FROM mentions m JOIN event_docs USING (document_id)) WHERE n = 1")
def win_first_mention(g: Lens) -> DataFrame:
    seen = g.mentions.join(g.event_docs.select("document_id", "source_system", F.col("external_id").cast("long").alias("seq")), "document_id")
    return reads.ranked(seen, ["node_id", "source_system"], [F.col("seq")], 1).select("node_id", "document_id")


@query("SELECT * FROM (SELECT source_id AS node_id, target_id AS other_id, row_number() OVER (PARTITION BY source_id ORDER BY relationship, target_id) AS rank FROM e_depends_on) WHERE rank <= 5")
def win_topk_per_entity(g: Lens) -> DataFrame:
    near = g.edges("DEPENDS_ON").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id"), "relationship")
    return reads.ranked(near, ["node_id"], [F.col("relationship"), F.col("other_id")], 5).select("node_id", "other_id", "rank")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_60s FROM events")
def win_sliding_60s(g: Lens) -> DataFrame:
    """Windows are of one type and minute: an event counts in its own minute and, for what follows, in the next."""
    e = g.table("events").select("event_id", "event_type", F.unix_micros("ts").alias("at"))
    e = e.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("minute", F.floor(F.col("at") / 60_000_000) + F.col("again"))
    last = Window.partitionBy("event_type", "minute").orderBy("at").rangeBetween(-59_999_999, 0)
    return e.withColumn("in_60s", F.count(F.lit(1)).over(last)).where("again = 0").select("event_id", "in_60s")


def doomed(names: DataFrame, keep: int) -> DataFrame:
    """Names beyond the newest ``keep``; ranges of names are sorted in parallel, and what stays is a small top list."""
    if keep <= 0:
        return names
    return names.join(names.orderBy(F.col("name").desc()).limit(keep), "name", "left_anti")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS name FROM events WHERE strftime(ts, '%Y-%m-%d') NOT IN (SELECT DISTINCT strftime(ts, '%Y-%m-%d') FROM events ORDER BY 1 DESC LIMIT 7)")
def win_prune_newest_n(g: Lens) -> DataFrame:
    return doomed(g.table("events").select(F.date_format("ts", "yyyy-MM-dd").alias("name")).distinct(), 7)


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS name FROM events")
def prune_snapshots(g: Lens) -> DataFrame:
    return doomed(g.table("events").select(F.date_format("ts", "yyyy-MM-dd").alias("name")).distinct(), 0)


# --- top-k


@query("SELECT node_id, name, stale_since FROM (SELECT 'customer:' || c_custkey AS node_id, c_name AS name, strftime(DATE '2023-01-01' + (c_custkey % 300)::INT, '%Y-%m-%d') AS stale_since FROM customer WHERE c_acctbal < 0) ORDER BY stale_since NULLS LAST, name, node_id LIMIT 20")
def topk_stale(g: Lens) -> DataFrame:
    stale = g.nodes("customer").where(scores.flagged(F.col("properties"), "stale")).select("node_id", "name", F.try_element_at("properties", F.lit("stale_since")).alias("stale_since"))
    return stale.orderBy(F.col("stale_since").asc_nulls_last(), "name", "node_id").limit(20)


@query("SELECT node_id, created_at FROM n_order ORDER BY created_at DESC, node_id LIMIT 20")
def topk_recent(g: Lens) -> DataFrame:
    return g.nodes("order").where("canonical_node_id is null").select("node_id", "created_at").orderBy(F.col("created_at").desc(), "node_id").limit(20)


@query("SELECT document_id, source_updated_at AS ts FROM event_docs ORDER BY ts DESC NULLS LAST, document_id LIMIT 20")
def topk_timeline(g: Lens) -> DataFrame:
    return g.event_docs.select("document_id", F.col("source_updated_at").alias("ts")).orderBy(F.col("ts").desc_nulls_last(), "document_id").limit(20)


@query(PROPOSALS + "SELECT proposal_id, confidence FROM proposals WHERE status = 'pending' ORDER BY confidence DESC, created_at, proposal_id LIMIT 20")
def topk_queue(g: Lens) -> DataFrame:
    return proposals(g).where("status = 'pending'").orderBy(F.col("confidence").desc(), "created_at", "proposal_id").limit(20).select("proposal_id", "confidence")


@query("SELECT event_id, ts AS occurred_at FROM events ORDER BY ts DESC, event_id LIMIT 20")
def topk_audit(g: Lens) -> DataFrame:
    return g.table("events").select("event_id", F.col("ts").alias("occurred_at")).orderBy(F.col("occurred_at").desc(), "event_id").limit(20)


@query("SELECT document_id FROM event_docs ORDER BY ingested_at DESC, document_id LIMIT 10")
def sample_recent_docs(g: Lens) -> DataFrame:
    return g.event_docs.orderBy(F.col("ingested_at").desc(), "document_id").limit(10).select("document_id")


# --- set operations


@query("SELECT DISTINCT source_system, resource_key FROM event_docs WHERE source_system IN ('click', 'view') OR (source_system = 'purchase' AND resource_key IN ('1', '2', '3'))")
def set_union_grants(g: Lens) -> DataFrame:
    return visibility.visible_documents(g.event_docs, g.grants, ["eng", "sales"]).select("source_system", "resource_key").distinct()


@query("SELECT DISTINCT target_id FROM e_links")
def set_distinct_concepts(g: Lens) -> DataFrame:
    return g.edges("LINKS").select("target_id").distinct()


# --- reads


@query(""", scope AS (SELECT node_id FROM visible UNION SELECT 'nation:' || c_nationkey FROM customer JOIN visible ON node_id = 'customer:' || c_custkey)
 SELECT 'nodes' AS section, node_type AS label, count(*) AS value FROM nodes SEMI JOIN scope USING (node_id) WHERE canonical_node_id IS NULL GROUP BY 2
 UNION ALL SELECT 'edges', relationship, count(*) FROM edges WHERE source_id IN (SELECT node_id FROM scope) AND target_id IN (SELECT node_id FROM scope) GROUP BY 2""")
def graph_stats(g: Lens) -> DataFrame:
    """Events mention a customer and with it the customer's nation, so edges between the two are in sight."""
    home = g.table("customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("node_id"), F.concat(F.lit("nation:"), "c_nationkey").alias("nation"))
    mentions = g.mentions.select("node_id", "document_id")
    mentions = mentions.unionByName(mentions.join(home, "node_id").select(F.col("nation").alias("node_id"), "document_id"))
    ids = visibility.visible_node_ids(mentions, g.event_docs, g.grants, _SALES)
    return reports.graph_stats(g.nodes(), g.edges(), written(ids, "visible"))


@query(_HEALTH)
def connector_health(g: Lens) -> DataFrame:
    return reports.connector_health(g.runs)


@query("""SELECT node_id, node_type, name, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(n_sources, 0) AS n_sources, coalesce(systems, []) AS systems FROM n_customer
 LEFT JOIN (SELECT node_id, count(*) FILTER (WHERE o) AS n_out, count(*) FILTER (WHERE NOT o) AS n_in FROM (SELECT source_id AS node_id, true AS o FROM edges UNION ALL SELECT target_id, false FROM edges) GROUP BY 1) USING (node_id)
 LEFT JOIN (SELECT node_id, count(*) AS n_sources, list_sort(list(DISTINCT source_system)) AS systems FROM mentions JOIN visible_docs USING (document_id) GROUP BY 1) USING (node_id)""")
def node_details(g: Lens) -> DataFrame:
    docs = visibility.visible_documents(g.event_docs, g.grants, _SALES)
    return reads.node_details(g.nodes("customer"), g.edges("MEMBER_OF", "AUTHORED"), g.mentions, docs)


@query("""SELECT node_id, direction, relationship, other_id, name, n.node_type, confidence, weight FROM (
 SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY relationship, other_id) AS k FROM (
 SELECT source_id AS node_id, 'out' AS direction, relationship, target_id AS other_id, confidence, weight FROM (SELECT * FROM e_member_of UNION ALL SELECT * FROM e_part_of) UNION ALL
 SELECT target_id, 'in', relationship, source_id, confidence, weight FROM (SELECT * FROM e_member_of UNION ALL SELECT * FROM e_part_of))) e
 JOIN (SELECT node_id AS other_id, name, node_type FROM nodes) n USING (other_id) WHERE k <= 25""")
def node_neighbors(g: Lens) -> DataFrame:
    return reads.neighbors(g.edges("MEMBER_OF", "PART_OF"), g.nodes("region", "nation", "customer", "supplier"), "both", 25)


@query("SELECT * FROM (SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY source_updated_at DESC NULLS LAST, document_id) AS rank, document_id, source_system, source_updated_at AS ts FROM mentions JOIN visible_docs USING (document_id)) WHERE rank <= 20")
def entity_timeline(g: Lens) -> DataFrame:
    return reads.entity_timeline(g.mentions, visibility.visible_documents(g.event_docs, g.grants, _SALES))


@query("SELECT * FROM (SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY ingested_at, document_id) AS rank, document_id, ingested_at AS ts, substr(context, 1, 160) AS snippet FROM mentions JOIN visible_docs USING (document_id)) WHERE rank <= 200")
def node_story(g: Lens) -> DataFrame:
    return reads.node_story(g.mentions, visibility.visible_documents(g.event_docs, g.grants, _SALES))


@query("SELECT node_id, coalesce(canonical_node_id, node_id) AS root FROM n_part")
def resolve_canonical(g: Lens) -> DataFrame:
    return reads.resolve_canonical(g.parts)


@query(PROPOSALS + """SELECT * FROM (SELECT 'node' AS what, node_id AS id, created_at AS ts FROM n_order WHERE created_at >= TIMESTAMP '1998-07-01' ORDER BY ts DESC, id LIMIT 50)
 UNION ALL SELECT * FROM (SELECT 'proposal', proposal_id, applied_at FROM proposals WHERE applied_at >= TIMESTAMP '1998-07-01' ORDER BY 3 DESC, 2 LIMIT 50)""")
def recent_changes(g: Lens) -> DataFrame:
    since = F.lit("1998-07-01").cast("timestamp")
    made = g.nodes("order").where(F.col("canonical_node_id").isNull() & (F.col("created_at") >= since)).select(F.lit("node").alias("what"), F.col("node_id").alias("id"), F.col("created_at").alias("ts"))
    done = proposals(g).where(F.col("applied_at") >= since).select(F.lit("proposal").alias("what"), F.col("proposal_id").alias("id"), F.col("applied_at").alias("ts"))
    return made.orderBy(F.col("ts").desc(), "id").limit(50).unionByName(done.orderBy(F.col("ts").desc(), "id").limit(50))


@query("SELECT node_id, created_at FROM n_order WHERE created_at >= TIMESTAMP '1998-07-01' ORDER BY created_at DESC, node_id LIMIT 50")
def recent_nodes(g: Lens) -> DataFrame:
    return g.nodes("order").where("canonical_node_id is null and created_at >= timestamp'1998-07-01'").select("node_id", "created_at").orderBy(F.col("created_at").desc(), "node_id").limit(50)


@query("SELECT node_id, name, stale_since FROM (SELECT 'customer:' || c_custkey AS node_id, c_name AS name, strftime(DATE '2023-01-01' + (c_custkey % 300)::INT, '%Y-%m-%d') AS stale_since FROM customer WHERE c_acctbal < 0) ORDER BY stale_since NULLS LAST, name, node_id LIMIT 50")
def stale_nodes(g: Lens) -> DataFrame:
    stale = g.nodes("customer").where(scores.flagged(F.col("properties"), "stale")).select("node_id", "name", F.try_element_at("properties", F.lit("stale_since")).alias("stale_since"))
    return stale.orderBy(F.col("stale_since").asc_nulls_last(), "name", "node_id").limit(50)


@query("SELECT event_id, user_id::VARCHAR AS subject, ts AS occurred_at FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id LIMIT 100")
def audit_trail(g: Lens) -> DataFrame:
    """A principal that is no superuser sees its own rows only."""
    log = g.table("events").select("event_id", F.col("user_id").cast("string").alias("subject"), F.col("ts").alias("occurred_at"))
    return log.where("subject = '3'").orderBy(F.col("occurred_at").desc(), "event_id").limit(100)


_DIGEST = """SELECT 1 AS section, source_system || ' ' || status AS position, source_system || ': ' || count(*) || ' run(s) ' || status AS line FROM runs WHERE started_at >= TIMESTAMP '2024-01-25' GROUP BY source_system, status
 UNION ALL SELECT 2, '', 'documents ingested: ' || count(*) FROM event_docs WHERE ingested_at >= TIMESTAMP '2024-01-25'
 UNION ALL SELECT 3, '', 'entities created: ' || count(*) FROM n_order WHERE created_at >= TIMESTAMP '2024-01-25'
 UNION ALL SELECT 4, kind, 'filed ' || count(*) || ' ' || kind || ' proposal(s)' FROM proposals WHERE created_at >= TIMESTAMP '2024-01-25' GROUP BY kind
 UNION ALL SELECT 5, kind, 'applied ' || count(*) || ' ' || kind || ' proposal(s)' FROM proposals WHERE applied_at >= TIMESTAMP '2024-01-25' GROUP BY kind
 UNION ALL SELECT 6, '', 'rejected ' || count(*) || ' proposal(s)' FROM proposals WHERE status = 'rejected' AND decided_at >= TIMESTAMP '2024-01-25' HAVING count(*) > 0
 UNION ALL SELECT 7, '', 'pending review now: ' || count(*) FROM proposals WHERE status = 'pending'"""


@query(PROPOSALS + _DIGEST)
def digest(g: Lens) -> DataFrame:
    return reports.digest(g.runs, g.event_docs, g.nodes("order"), proposals(g), g.now)
