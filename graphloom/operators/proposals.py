"""The proposal queue and what its proposals do: every apply gives new table images and a snapshot that undoes it."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..session import written
from . import resolve, scans


def submit(queue: DataFrame, found: DataFrame, now: Column, auto_apply: float | None = None) -> DataFrame:
    """The queue with findings whose (kind, dedup_key) it has not seen in any status; sure ones are auto-applied."""
    filed = queue.where("dedup_key is not null").select("kind", "dedup_key").distinct()
    once = found.withColumn("_n", F.row_number().over(Window.partitionBy("kind", F.coalesce("dedup_key", F.uuid())).orderBy(F.col("confidence").desc()))).where("_n = 1").drop("_n")
    fresh = once.join(filed, ["kind", "dedup_key"], "left_anti")
    status = F.lit("pending") if auto_apply is None else F.when(F.col("confidence") >= auto_apply, "auto_applied").otherwise("pending")
    fresh = fresh.withColumn("proposal_id", F.sha2(F.concat_ws("|", "kind", F.coalesce("dedup_key", F.to_json(F.map_entries("payload")))), 256)).withColumn("status", status).withColumn("created_at", now)
    return queue.unionByName(fresh, allowMissingColumns=True)


def decide(queue: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The queue after decisions (proposal_id, action, reviewer), and those that its statuses don't allow.

    Pending proposals can be approved or rejected, applied ones rolled back.
    """
    both = queue.join(decisions, "proposal_id", "left")
    legal = ((F.col("status") == "pending") & F.col("action").isin("approve", "reject")) | (F.col("status").isin("approved", "auto_applied") & (F.col("action") == "rollback"))
    to = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise("rolled_back")
    cols = {
        "status": F.when(legal, to).otherwise(F.col("status")), "decided_at": F.when(legal, now).otherwise(F.col("decided_at")),
        "applied_at": F.when(legal & (F.col("action") == "approve"), now).otherwise(F.col("applied_at")), "reviewed_by": F.when(legal, F.col("reviewer")).otherwise(F.col("reviewed_by")),
    }
    bad = both.where(F.col("action").isNotNull() & ~F.coalesce(legal, F.lit(False))).select("proposal_id", "action", F.concat(F.lit("cannot "), "action", F.lit(" a proposal that is "), "status").alias("error"))
    unknown = decisions.join(queue, "proposal_id", "left_anti").select("proposal_id", "action", F.lit("no such proposal").alias("error"))
    return both.withColumns(cols).select(queue.columns), bad.unionByName(unknown)


def approve_over(queue: DataFrame, floor: float) -> DataFrame:
    """Decisions that approve all pending proposals of at least a confidence."""
    return queue.where((F.col("status") == "pending") & (F.col("confidence") >= floor)).select("proposal_id", F.lit("approve").alias("action"), F.lit("batch").alias("reviewer"))


def failed_log(queue: DataFrame, errors: DataFrame) -> DataFrame:
    """Proposals that could not be applied are failed, with at most 2,000 characters of the reason."""
    e = errors.groupBy("proposal_id").agg(F.min(F.substring("error", 1, 2000)).alias("_error"))
    both = queue.join(e, "proposal_id", "left")
    return both.withColumns({"status": F.when(F.col("_error").isNotNull(), "failed").otherwise(F.col("status")), "error": F.coalesce("_error", "error")}).select(queue.columns)


@dataclass
class Merge:
    """Images after a merge, snapshots of the rows before it, and versions of the rows it left.

    ``mapping`` (old_id, new_id) has each loser's winner, ``roots`` (old_id, new_id, path) where it ends up, over any
    number of merges.
    """

    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame
    errors: DataFrame
    mapping: DataFrame
    roots: DataFrame
    before_nodes: DataFrame
    before_edges: DataFrame
    before_mentions: DataFrame
    node_versions: DataFrame
    edge_versions: DataFrame


def _in_turn(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges that succeed and those that come too late, as if done one after another by ``order``: a merge fails if one
    of its nodes was merged away before, so several losers may share a winner, and a winner may be merged away later.

    Each round accepts what comes before all undecided merges that would take one of its nodes away, and drops what an
    accepted merge has taken a node from. The first one undecided is accepted in any case, so rounds end; they are as
    many as the longest chain of merges that wait for each other.
    """
    open_, done, late = written(good, "merges-open"), [], []
    while not open_.isEmpty():
        goes = open_.groupBy(F.col("loser_id").alias("node_id")).agg(F.min("order").alias("gone_at"))
        both = open_.join(goes.toDF("winner_id", "_w"), "winner_id", "left").join(goes.toDF("loser_id", "_l"), "loser_id")
        first = (F.col("order") <= F.col("_l")) & (F.col("_w").isNull() | (F.col("order") < F.col("_w")))
        marked = written(both.withColumn("taken", first).select(*good.columns, "taken"), "merges-marked")
        taken = marked.where("taken").drop("taken")
        gone = taken.select(F.col("loser_id").alias("node_id"), F.col("order").alias("gone_at"))
        rest = marked.where("not taken").drop("taken").join(gone.toDF("winner_id", "_w"), "winner_id", "left").join(gone.toDF("loser_id", "_l"), "loser_id", "left")
        rest = written(rest.withColumn("lost", F.coalesce(F.col("order") > F.col("_w"), F.lit(False)) | F.coalesce(F.col("order") > F.col("_l"), F.lit(False))).select(*good.columns, "lost"), "merges-rest")
        done.append(taken)
        late.append(rest.where("lost").drop("lost"))
        open_ = rest.where("not lost").drop("lost")
    none = good.limit(0)
    return functools.reduce(DataFrame.unionByName, done, none), functools.reduce(DataFrame.unionByName, late, none)


def valid_merges(nodes: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges (proposal_id, winner_id, loser_id, order) that succeed, and the errors of the rest.

    Both nodes must exist, differ, be of one type and no aliases. The surest merge goes first, then the smaller id;
    one whose node was merged away by an earlier one fails.
    """
    n = nodes.select("node_id", "node_type", "canonical_node_id")
    both = merges.join(n.toDF("winner_id", "_wt", "_wc"), "winner_id", "left").join(n.toDF("loser_id", "_lt", "_lc"), "loser_id", "left")
    error = (
        F.when(F.col("winner_id") == F.col("loser_id"), "cannot merge a node into itself").when(F.col("_wt").isNull() | F.col("_lt").isNull(), "no such node")
        .when(F.col("_wt") != F.col("_lt"), "cannot merge across types").when(F.col("_wc").isNotNull() | F.col("_lc").isNotNull(), "already merged")
    )
    both = written(both.withColumn("error", error).select("proposal_id", "winner_id", "loser_id", F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("unsure"), "proposal_id").alias("order"), "error"), "merges")
    done, late = _in_turn(both.where("error is null").drop("error"))
    return done, both.where("error is not null").select("proposal_id", "error").unionByName(late.select("proposal_id", F.lit("already merged").alias("error")))


def _roots(good: DataFrame) -> DataFrame:
    """old_id, new_id (the node that is left at the end) and path, the orders of the merges from there down to old_id: what
    a winner takes first comes first. Every round doubles the merges that a row has passed."""
    at = written(good.select(F.col("loser_id").alias("old_id"), F.col("winner_id").alias("new_id"), F.array("order").alias("path")), "roots")
    while True:
        up = at.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("_up"), F.col("path").alias("_path"))
        step = written(at.join(up, "new_id", "left").withColumn("moved", F.col("_up").isNotNull()), "roots-step")
        if step.where("moved").isEmpty():
            return at
        at = written(step.select("old_id", F.coalesce("_up", "new_id").alias("new_id"), F.when(F.col("moved"), F.concat("_path", "path")).otherwise(F.col("path")).alias("path")), "roots")


def _versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a version of each row: a digest of all its columns."""
    plain = [F.array_sort(F.map_entries(f"`{c}`")).alias(c) if kind.startswith("map") else F.col(f"`{c}`") for c, kind in rows.dtypes]
    return rows.select(*keys, F.xxhash64(F.to_json(F.struct(*plain))).alias("_version"))


def apply_entity_merge(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, merges: DataFrame) -> Merge:
    """Losers become aliases of winners, as if merges were done one after another.

    Edges move to the node that is left at the end, loops go, twins fold (weights add, highest confidence, properties of
    the winner's first, then of those merged first); mentions move alike; winners keep their values and take what they
    lack from their losers in turn.
    """
    good, errors = valid_merges(nodes, merges)
    mapping, roots = good.select(F.col("loser_id").alias("old_id"), F.col("winner_id").alias("new_id")), _roots(good)
    top = F.array().cast(roots.schema["path"].dataType)
    a, b = roots.toDF("source_id", "_s", "_sp"), roots.toDF("target_id", "_t", "_tp")
    moved = edges.join(a, "source_id", "left").join(b, "target_id", "left").withColumn("_moved", F.col("_s").isNotNull() | F.col("_t").isNotNull())
    moved = moved.withColumns({"_src": F.coalesce("_s", "source_id"), "_tgt": F.coalesce("_t", "target_id"), "_at": F.struct(F.coalesce("_sp", top).alias("s"), F.coalesce("_tp", top).alias("t"), -F.col("weight"), "source_id", "target_id")})
    touched = moved.where("_moved").select("_src", "_tgt", "relationship").distinct().withColumn("_hit", F.lit(True))
    moved = written(moved.join(touched, ["_src", "_tgt", "relationship"], "left").drop("_s", "_t", "_sp", "_tp"), "moved-edges")  # three answers come from it
    keyed = moved.where("not (_moved and _src = _tgt)")
    same = keyed.where("_hit is null").select(edges.columns)
    hit = keyed.where("_hit").groupBy("_src", "_tgt", "relationship").agg(
        F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), F.min_by("evidence_document_id", "_at").alias("evidence_document_id"),
        F.array_sort(F.collect_list(F.struct(F.col("_at").alias("o"), F.map_entries("properties").alias("e")))).alias("bags"),
    )
    empty = F.create_map().cast("map<string,string>")
    fold = F.aggregate("bags", empty, lambda m, x: scores.merge_old_wins(m, F.map_from_entries(x["e"])))
    made = hit.select(F.col("_src").alias("source_id"), F.col("_tgt").alias("target_id"), "relationship", "weight", "confidence", "evidence_document_id", fold.alias("properties")).select(edges.columns)
    before_edges = moved.where("_hit").select(edges.columns)

    m = mentions.join(roots.toDF("node_id", "_n", "_path"), "node_id", "left")
    seen = m.select(F.coalesce("_n", "node_id").alias("node_id"), "document_id", "context", F.struct(F.coalesce("_path", top).alias("path"), "context").alias("_o"))
    new_mentions = seen.groupBy("node_id", "document_id").agg(F.min_by("context", "_o").alias("context"))
    pool = mapping.select(F.col("old_id").alias("node_id")).unionByName(mapping.select(F.col("new_id").alias("node_id"))).distinct()
    before_mentions = mentions.join(pool, "node_id", "left_semi")

    # what a node takes: from all that were merged into it, over any number of merges, the first that has it
    below = _below(good)
    own = nodes.select(F.col("node_id").alias("old_id"), F.col("properties").alias("_p"), F.nullif("summary", F.lit("")).alias("_sum"), F.col("confidence").alias("_c"))
    given = below.join(own, "old_id")
    bags = given.select("new_id", "path", F.explode("_p").alias("k", "v")).groupBy("new_id", "k").agg(F.min_by("v", "path").alias("v"))
    bags = bags.groupBy("new_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_p"))
    gains = given.groupBy("new_id").agg(F.min_by("_sum", F.when(F.col("_sum").isNotNull(), F.col("path"))).alias("_sum"), F.max("_c").alias("_c")).join(bags, "new_id", "left").withColumnRenamed("new_id", "node_id")
    out = nodes.join(gains, "node_id", "left").join(mapping.toDF("node_id", "_alias"), "node_id", "left")
    cols = {
        "properties": F.when(F.col("_p").isNotNull(), scores.merge_old_wins(F.col("properties"), F.col("_p"))).otherwise(F.col("properties")), "summary": F.coalesce(F.nullif("summary", F.lit("")), "_sum", "summary"),
        "confidence": F.greatest("confidence", "_c"), "canonical_node_id": F.coalesce("_alias", "canonical_node_id"),
    }
    new_nodes = out.withColumns(cols).select(nodes.columns)
    left = new_nodes.join(pool, "node_id", "left_semi")
    return Merge(new_nodes, same.unionByName(made), new_mentions, errors, mapping, roots, nodes.join(pool, "node_id", "left_semi"), before_edges, before_mentions, _versions(left, ["node_id"]), _versions(made, resolve.EDGE_KEY))


def _below(good: DataFrame) -> DataFrame:
    """old_id, new_id, path for every node and each of those it was merged into, directly or not."""
    single = good.select(F.col("loser_id").alias("old_id"), F.col("winner_id").alias("new_id"), F.array("order").alias("path"))
    out = [single]
    step = single
    while True:
        up = single.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("_up"), F.col("path").alias("_path"))
        step = written(step.join(up, "new_id").select("old_id", F.col("_up").alias("new_id"), F.concat("_path", "path").alias("path")), "merges-below")
        if step.isEmpty():
            return functools.reduce(DataFrame.unionByName, out)
        out.append(step)


def _changed(rows: DataFrame, versions: DataFrame, keys: list[str]) -> list[str]:
    """Names of rows that are gone or no longer as the merge left them, at most twenty."""
    both = versions.withColumnRenamed("_version", "_left").join(_versions(rows, keys), keys, "left")
    return [" ".join(str(v) for v in r) for r in both.where("not _version <=> _left").select(*keys).orderBy(*keys).limit(20).collect()]


def rollback_entity_merge(merge: Merge, nodes: DataFrame, edges: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and mentions as they were; refused (ValueError) by name if a row that the merge left has another
    version since."""
    changed = _changed(nodes, merge.node_versions, ["node_id"]) + _changed(edges, merge.edge_versions, resolve.EDGE_KEY)
    if changed:
        raise ValueError(f"a merged row has changed since: {', '.join(changed)}")
    ids = merge.before_nodes.select("node_id")
    old_nodes = nodes.join(ids, "node_id", "left_anti").unionByName(merge.before_nodes)
    old_edges = edges.join(merge.edge_versions, resolve.EDGE_KEY, "left_anti").unionByName(merge.before_edges)
    old_mentions = mentions.join(ids, "node_id", "left_anti").unionByName(merge.before_mentions)
    return old_nodes, old_edges, old_mentions


def apply_stale_flag(nodes: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with stale and stale_since of flags (node_id, last_seen); errors; images before."""
    both = nodes.join(flags.groupBy("node_id").agg(F.min("last_seen").alias("_day")), "node_id", "left")
    ok = F.col("_day").isNotNull() & F.col("canonical_node_id").isNull() & ~scores.flagged(F.col("properties"), "stale")
    bag = scores.stamp(scores.stamp(F.col("properties"), "stale", F.lit("true")), "stale_since", F.col("_day"))
    errors = both.where(F.col("_day").isNotNull() & ~ok).select("node_id", F.when(F.col("canonical_node_id").isNotNull(), "node is an alias").otherwise("already flagged").alias("error"))
    errors = errors.unionByName(flags.join(nodes, "node_id", "left_anti").select("node_id", F.lit("no such node").alias("error")))
    return both.withColumn("properties", F.when(ok, bag).otherwise(F.col("properties"))).select(nodes.columns), errors, both.where(ok).select(nodes.columns)


def restore_nodes(nodes: DataFrame, before: DataFrame) -> DataFrame:
    """Nodes with images from before an apply put back, also those that are gone."""
    return nodes.join(before.select("node_id"), "node_id", "left_anti").unionByName(before)


def apply_fact_conflict(nodes: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``disputed.<key>`` for conflicts (node_id, key, value, alias_value), no side winning; images before."""
    bags = conflicts.groupBy("node_id", "key").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("value", "alias_value"))))), " | ").alias("v"))
    bags = bags.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("disputed."), "key"), "v"))).alias("_bag"))
    both = nodes.join(bags, "node_id", "left")
    return both.withColumn("properties", scores.merge_new_wins(F.col("properties"), F.col("_bag"))).select(nodes.columns), both.where("_bag is not null").select(nodes.columns)


def apply_edge_add(edges: DataFrame, nodes: DataFrame, adds: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with those of adds (source_id, target_id, relationship, confidence) that pass, and the errors of the rest."""
    n = nodes.select("node_id", F.col("canonical_node_id").isNotNull().alias("alias"))
    rows = adds.dropDuplicates(resolve.EDGE_KEY).join(n.toDF("source_id", "_sa"), "source_id", "left").join(n.toDF("target_id", "_ta"), "target_id", "left")
    rows = rows.join(registry.select("relationship", F.lit(True).alias("_known")), "relationship", "left").join(edges.select(*resolve.EDGE_KEY, F.lit(True).alias("_there")).distinct(), resolve.EDGE_KEY, "left")
    error = F.when(F.col("source_id") == F.col("target_id"), "edge to itself").when(F.col("_sa").isNull() | F.col("_ta").isNull(), "no such node").when(F.col("_sa") | F.col("_ta"), "node is an alias").when(F.col("_known").isNull(), "unknown relationship").when(F.col("_there"), "edge exists")
    rows = rows.withColumn("error", error)
    made = rows.where("error is null").select(*resolve.EDGE_KEY, F.lit(1.0).alias("weight"), "confidence")
    return edges.unionByName(made, allowMissingColumns=True), rows.where("error is not null").select(*resolve.EDGE_KEY, "error")


def apply_node_removal(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes without those of ``ids`` that are still orphans; errors; images of the removed."""
    gone = scans.orphans(nodes, edges, mentions).join(ids, "node_id", "left_semi")
    errors = ids.join(gone, "node_id", "left_anti").select("node_id", F.lit("node is not an orphan").alias("error"))
    return nodes.join(gone, "node_id", "left_anti"), errors, gone.select(nodes.columns)


def apply_edge_removal(edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without those named, and the removed ones."""
    return edges.join(keys, resolve.EDGE_KEY, "left_anti"), edges.join(keys, resolve.EDGE_KEY, "left_semi")


def apply_schema_type(registry: DataFrame, names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The vocabulary (column ``key``) with new valid names, and the errors of the rest."""
    rows = names.select("name").distinct().join(registry.select(F.col(key).alias("name"), F.lit(True).alias("_there")), "name", "left")
    rows = rows.withColumn("error", F.when(~text.valid_type_name(F.col("name"), key == "relationship"), "invalid name").when(F.col("_there"), "exists"))
    return registry.unionByName(rows.where("error is null").select(F.col("name").alias(key)), allowMissingColumns=True), rows.where("error is not null").select("name", "error")


def rollback_schema_type(registry: DataFrame, names: DataFrame, used: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The vocabulary without names that nothing uses (``used`` has the column ``key``); the rest is refused."""
    asked = names.select(F.col("name").alias(key))
    busy = asked.join(used.select(key).distinct(), key, "left_semi")
    return registry.join(asked.join(busy, key, "left_anti"), key, "left_anti"), busy.select(F.col(key).alias("name"), F.lit("in use").alias("error"))


def queue_report(queue: DataFrame, status: str, limit: int, line: Column) -> DataFrame:
    """The surest proposals of a status first, each with a line of text."""
    own = queue if status == "all" else queue.where(F.col("status") == status)
    return own.orderBy(F.col("confidence").desc(), "created_at", "proposal_id").limit(limit).select("proposal_id", "kind", "status", "confidence", line.alias("line"))
