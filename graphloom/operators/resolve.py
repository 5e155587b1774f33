"""Set-based upserts: documents, nodes, edges and mentions of many observations at once."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..session import written

DOC_KEY = ["source_system", "source_type", "external_id"]
NODE_KEY = ["node_type", "source_system", "external_id"]
EDGE_KEY = ["source_id", "target_id", "relationship"]


def fold_bags(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """keys, properties: bags of many rows folded so that of each property the latest value wins.

    Values are folded by property, so a group of any size leaves one value a property.
    """
    single = rows.select(*keys, order, F.explode("properties").alias("k", "v")).groupBy(*keys, "k").agg(F.max_by("v", order).alias("v"))
    return single.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))


def _with_bags(folded: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    out = folded.join(fold_bags(rows, keys), keys, "left")
    return out.withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def fold_edges(seen: DataFrame) -> DataFrame:
    """Observations to edges: weight counts them, confidence is the highest, evidence and properties the latest."""
    folded = seen.groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.max("confidence").alias("confidence"), F.max_by("evidence_document_id", "seq").alias("evidence_document_id"))
    return _with_bags(folded, seen, EDGE_KEY)


def fold_nodes(seen: DataFrame) -> DataFrame:
    """Observations of sourced nodes: latest name and summary, highest confidence, latest properties."""
    folded = seen.groupBy(*NODE_KEY).agg(F.max_by("name", "seq").alias("name"), F.max_by("summary", "seq").alias("summary"), F.max("confidence").alias("confidence"))
    return _with_bags(folded, seen, NODE_KEY)


def arrived_documents(incoming: DataFrame) -> DataFrame:
    """The latest arrival, by ``seq``, of each document, with its content hash."""
    fields = [c for c in incoming.columns if c not in (*DOC_KEY, "seq")]
    latest = incoming.groupBy(*DOC_KEY).agg(F.max_by(F.struct(*fields), "seq").alias("n")).select(*DOC_KEY, "n.*")
    return latest.withColumn("content_hash", text.content_hash(F.col("content")))


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The new image of the document table. Of repeated arrivals the latest ``seq`` counts; a known document keeps its
    source_created_at and extracted_hash, all else is replaced."""
    latest = arrived_documents(incoming).withColumn("_new", F.lit(True))
    n, o = latest.alias("n"), current.withColumn("_old", F.lit(True)).alias("o")
    both = o.join(n, DOC_KEY, "full_outer")
    cols = []
    for c in current.columns:
        if c in DOC_KEY:
            cols.append(F.col(c))
        elif c == "extracted_hash" or c not in latest.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif c == "source_created_at":
            cols.append(F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*cols)


def upsert_sourced(current: DataFrame, seen: DataFrame) -> DataFrame:
    """New image of sourced nodes with ``change``: created, updated or kept."""
    n, o = fold_nodes(seen).withColumn("_new", F.lit(True)).alias("n"), current.withColumn("_old", F.lit(True)).alias("o")
    both = o.join(n, NODE_KEY, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    change = F.when(F.col("_old") & F.col("_new"), "updated").when(F.col("_new"), "created").otherwise("kept")
    return both.select(*NODE_KEY, pick("name"), pick("summary"), F.greatest("o.confidence", "n.confidence").alias("confidence"), scores.merge_new_wins(F.col("o.properties"), F.col("n.properties")).alias("properties"), change.alias("change"))


def upsert_edges(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Current edges with new observations: weights add up, confidence is the highest, properties and evidence new."""
    n, o = fold_edges(seen).alias("n"), current.alias("o")
    zero = F.lit(0.0)
    return o.join(n, EDGE_KEY, "full_outer").select(
        *EDGE_KEY, (F.coalesce("o.weight", zero) + F.coalesce("n.weight", zero)).alias("weight"), F.greatest("o.confidence", "n.confidence").alias("confidence"),
        F.coalesce("n.evidence_document_id", "o.evidence_document_id").alias("evidence_document_id"), scores.merge_new_wins(F.col("o.properties"), F.col("n.properties")).alias("properties"),
    )


def record_edges(ledger: DataFrame | None, seen: DataFrame, batch_id: str) -> DataFrame:
    """The ledger of what each batch has added to each edge, with this batch in place of an earlier delivery of it.

    Batches may come again, and in any order: ``edges_of`` gives the same edges.
    """
    last = seen.groupBy(*EDGE_KEY).agg(F.max("seq").alias("last_seq"))
    rows = fold_edges(seen).join(last, EDGE_KEY).withColumn("batch_id", F.lit(batch_id))
    return rows if ledger is None else ledger.where(F.col("batch_id") != batch_id).unionByName(rows)


def edges_of(ledger: DataFrame) -> DataFrame:
    """Edges of all batches of a ledger: weights add up, confidence is the highest, evidence is of the batch that saw the
    edge last, and so is each property of the last batch that has it; ties go to the greater batch id."""
    order = F.struct("last_seq", "batch_id").alias("at")
    rows = ledger.select(*EDGE_KEY, "weight", "confidence", "evidence_document_id", "properties", order)
    folded = rows.groupBy(*EDGE_KEY).agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), F.max_by("evidence_document_id", "at").alias("evidence_document_id"))
    out = folded.join(fold_bags(rows, EDGE_KEY, "at"), EDGE_KEY, "left")
    return out.withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def record_mentions(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Current mentions and, first ones winning, new ones; contexts of at most 1,000 characters."""
    first = seen.groupBy("node_id", "document_id").agg(F.min_by("context", "seq").alias("context")).withColumn("context", F.substring("context", 1, 1000))
    return current.unionByName(first.join(current, ["node_id", "document_id"], "left_anti").select(current.columns))


def name_pairs(names: DataFrame, threshold: float, known: DataFrame | None = None) -> DataFrame:
    """node_type, a, b, similarity of different names of a type with trigram similarity at or over the threshold; with
    ``known``, of a name (a) and a known one (b) only.

    Names meet on their rarest trigrams only (as many as the threshold asks for), then are scored exactly.
    """
    sides = names.select("node_type", "name", F.lit(True).alias("asked"))
    if known is not None:
        sides = sides.unionByName(known.select("node_type", "name", F.lit(False).alias("asked")))
    sides = sides.distinct().withColumn("grams", text.trigrams(F.col("name"))).withColumn("n", F.size("grams")).where("n > 0")
    single = sides.select("node_type", "name", "asked", "n", F.explode("grams").alias("gram"))
    often = single.groupBy("node_type", "gram").agg(F.count(F.lit(1)).alias("often"))
    rare = single.join(often, ["node_type", "gram"]).withColumn("k", F.row_number().over(Window.partitionBy("node_type", "name", "asked").orderBy("often", "gram")))
    rare = rare.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("node_type", "gram", "name", "n", "asked")
    x, y = rare.where("asked").alias("x"), rare.where("asked" if known is None else "not asked").alias("y")
    meet = (F.col("x.node_type") == F.col("y.node_type")) & (F.col("x.gram") == F.col("y.gram"))
    meet &= F.col("x.name") < F.col("y.name") if known is None else F.col("x.name") != F.col("y.name")
    meet &= F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold - 1e-9
    pairs = x.join(y, meet).select("x.node_type", F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()
    return pairs.withColumn("similarity", text.trigram_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= threshold)


#: Pivots, at most, which every task holds; vectors that they are picked from, for each of them.
PIVOTS, PICKED = 256, 8
#: Copies that leave a task at a time, at most; vectors on a side that are compared at a time.
PIECE, TILE = 8192, 2048


def pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """Unit vectors far from each other, each in turn the one farthest from those before it, among a bounded number
    picked by hash."""
    picked = vectors.orderBy(F.xxhash64("node_id"), "node_id").limit(PICKED * count).select(F.col("embedding").cast("array<double>")).collect()
    v = units([r[0] for r in picked]) if picked else np.zeros((0, 1))
    v = v[v.any(1)]
    if not len(v):
        return np.ones((1, 1))
    chosen, near = [0], v @ v[0]
    while len(chosen) < count and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    return v[chosen]


def in_cells(vectors: DataFrame, most: float, block_rows: int, asked: DataFrame | None = None) -> DataFrame:
    """Unit vectors (node_id, node_type, v) in the cells where they can meet others within a cosine distance: ``home``
    rows in the cell of their nearest pivot (``own``), copies in every cell that holds a vector near enough to them.

    There is a pivot for each ``block_rows`` vectors up to PIVOTS. By the triangle inequality, a vector has no partner in
    a cell if it is farther from the plane half way between the two pivots than the bound, or farther from the cell's
    pivot than the bound and the cell's radius. Without ``asked`` copies go to no later cell than their own, so
    every two cells meet once; with it, only its rows are copied, and only rows of ``vectors`` are at home. From a
    distance of 1 on, where angles bound nothing, all cells are reached.
    """
    rows = vectors.where("embedding is not null").select("node_id", "node_type", "embedding", F.lit(True).alias("known"))
    count = max(1, min(PIVOTS, math.ceil(rows.count() / block_rows)))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots(rows, count) if count > 1 else np.ones((1, 1)))  # one cell needs no pivot
    if asked is not None:
        rows = rows.unionByName(asked.where("embedding is not null").select("node_id", "node_type", "embedding", F.lit(False).alias("known")))
    bound, alone = math.sqrt(2 * most) + 1e-9 if most < 1 else math.inf, asked is None

    def distances(v: np.ndarray) -> np.ndarray:
        p = shared.value
        if len(p) == 1:
            return np.zeros((len(v), 1))
        return np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + 1 - 2 * v @ p.T))

    def at_home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in filter(len, frames):
            v = units(frame["v"])
            far = distances(v)
            yield frame.assign(v=list(v), own=far.argmin(1), far=far.min(1))

    rows = rows.select("node_id", "node_type", "known", F.col("embedding").cast("array<double>").alias("v"))
    homes = rows.mapInPandas(at_home, "node_id string, node_type string, known boolean, v array<double>, own long, far double")
    radius = np.full(count, 0.0 if count == 1 else -np.inf)
    if count > 1:
        homes = written(homes, "homes")
        for cell, far in homes.where("known").groupBy("own").agg(F.max("far")).collect():  # a row for each pivot
            radius[cell] = far

    def copied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
        rows = max(1, PIECE // len(p))  # which may go to all cells
        for frame in (x[i : i + rows] for x in frames for i in range(0, len(x), rows)):
            far, own = distances(np.array(frame["v"].tolist(), float).reshape(len(frame), -1)), frame["own"].to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                beyond = (far**2 - frame["far"].to_numpy()[:, None] ** 2) / (2 * apart[own])  # from the planes half way
            reached = ~(beyond > bound) & (far <= radius[: far.shape[1]] + bound)
            if alone:
                reached &= np.arange(far.shape[1]) <= own[:, None]
                reached[np.arange(len(own)), own] = True
            at, cell = np.nonzero(reached)
            yield frame.iloc[at].assign(cell=cell)

    schema = "node_id string, node_type string, known boolean, v array<double>, own long, far double, cell long"
    copies = (homes if alone else homes.where("not known")).mapInPandas(copied, schema).withColumn("home", F.lit(False))
    return homes.where("known").withColumns({"cell": F.col("own"), "home": F.lit(True)}).unionByName(copies).drop("known", "far")


def units(vectors: list) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in vectors], float).reshape(len(vectors), -1)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def vector_pairs(vectors: DataFrame, most: float, block_rows: int = 16384, same_type: bool = False, asked: DataFrame | None = None, places: int = 12) -> DataFrame:
    """(a, b, distance) with a < b of all vectors within a cosine distance; with ``asked``, of one of its rows (a) and
    one of ``vectors`` (b). Exact; distances are rounded to ``places`` before they are compared.

    Vectors meet in the cells of ``in_cells``. A cell's rows at home and its copies are dealt to blocks, block against
    block, so a cell of any size is many groups of two blocks each.
    """
    rows = written(in_cells(vectors, most + 10.0**-places, block_rows, asked), "cells")
    sizes = rows.groupBy("cell").agg(*(F.ceil(F.count(F.when(F.col("home") == at, 1)) / block_rows).alias(c) for c, at in (("homes", True), ("copies", False))))
    rows = rows.join(F.broadcast(sizes), "cell").where("homes > 0 and copies > 0")  # a row for each of at most PIVOTS cells
    block = lambda n: F.pmod(F.xxhash64("node_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    alone = asked is None
    meet = rows.where("home").select("*", block("homes").alias("i"), every("copies").alias("j")).unionByName(rows.where("not home").select("*", block("copies").alias("j"), every("homes").alias("i")))

    def close(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for f in frames:
            parts.append((np.array(f["v"].tolist(), float).reshape(len(f), -1), f["home"].to_numpy(bool), f["own"].to_numpy(), f["node_id"].to_numpy(), f["node_type"].to_numpy()))
        m, home, own, ids, kinds = (np.concatenate(x) for x in zip(*parts))
        left, right = np.flatnonzero(home), np.flatnonzero(~home)
        for i, j in ((i, j) for i in range(0, len(left), TILE) for j in range(0, len(right), TILE)):
            d = 1 - m[left[i : i + TILE]] @ m[right[j : j + TILE]].T
            x, y = np.nonzero(d <= most + 10.0**-places)
            a, b, d = left[i + x], right[j + y], np.round(d[x, y], places)
            keep = d <= most
            if alone:
                keep &= (own[b] != key[0]) | (ids[a] < ids[b])
            if same_type:
                keep &= kinds[a] == kinds[b]
            a, b, d = ids[a[keep]], ids[b[keep]], d[keep]
            swap = a > b if alone else np.ones(len(a), bool)
            for n in range(0, len(a), 1 << 18):
                at = slice(n, n + (1 << 18))
                yield pd.DataFrame({"a": np.where(swap[at], b[at], a[at]), "b": np.where(swap[at], a[at], b[at]), "distance": d[at]})

    return meet.groupBy("cell", "i", "j").applyInPandas(close, "a string, b string, distance double")


def match_derived(existing: DataFrame, incoming: DataFrame, threshold: float = 0.55, near: float = 0.15) -> DataFrame:
    """node_type, name, matched_id: for new names of derived nodes the known node of the type that is similar by name
    or, if both have an ``embedding``, within the cosine distance ``near``; then through its alias pointer to the
    canonical node.

    A new name with a vector takes the nearest by vector, one without it the most similar by name. Known nodes
    without a vector come after those with one. Ties go to the more similar name, then the smallest id. Only new names
    and vectors meet known ones; known ones never meet each other.
    """
    known = existing.where("external_id is null").withColumn("to", F.coalesce("canonical_node_id", "node_id"))
    by_name = known.groupBy("node_type", "name").agg(F.min("to").alias("to"))
    new = incoming.select("node_type", "name").distinct()
    vectors = "embedding" in existing.columns and "embedding" in incoming.columns
    if vectors:  # what is near by vector comes before all else, so only names without it are looked up by name
        asked = _asked(incoming)
        close = written(_close(known, asked, near), "close")
        new = new.join(close.select("node_type", "name").distinct(), ["node_type", "name"], "left_anti")
    same = new.join(by_name, ["node_type", "name"]).select("node_type", "name", F.col("name").alias("other"))
    found = same.unionByName(name_pairs(new, threshold, by_name).select("node_type", F.col("a").alias("name"), F.col("b").alias("other")))
    score = text.trigram_similarity(F.col("name"), F.col("other"))
    if not vectors:
        found = found.join(by_name.withColumnRenamed("name", "other"), ["node_type", "other"]).withColumn("similarity", score)
        return found.groupBy("node_type", "name").agg(F.min_by("to", F.struct(-F.col("similarity"), "to")).alias("matched_id"))
    least = close.groupBy("node_type", "name").agg(F.min("distance").alias("least"))
    nearest = close.join(least, ["node_type", "name"]).where(F.col("distance") <= F.col("least") + 1e-9).select("node_type", "name", "b")
    return _ranked(known, asked, found, nearest).groupBy("node_type", "name").agg(F.min_by("to", "order").alias("matched_id"))


def _asked(incoming: DataFrame) -> DataFrame:
    """node_type, name, v: each name's first vector."""
    return incoming.where("embedding is not null").groupBy("node_type", "name").agg(F.min_by("embedding", "seq").alias("v"))


def _close(known: DataFrame, asked: DataFrame, near: float) -> DataFrame:
    """node_type, name, b, distance: known nodes (b) of a name's type that are near by vector."""
    key = F.concat_ws("\x1f", "node_type", "name").alias("node_id")
    pairs = vector_pairs(known, near, same_type=True, asked=asked.select(key, "node_type", F.col("v").alias("embedding")))
    return pairs.join(asked.select(key.alias("a"), "node_type", "name"), "a").select("node_type", "name", "b", "distance")


def _ways(known: DataFrame, incoming: DataFrame, found: DataFrame, near: float) -> DataFrame:
    """node_type, name, to, node_id, order: known nodes that a new name may go to, by the names ``found`` (node_type,
    name, other) or by vector, and how they rank."""
    asked = _asked(incoming)
    return _ranked(known, asked, found, _close(known, asked, near).drop("distance"))


def _ranked(known: DataFrame, asked: DataFrame, found: DataFrame, close: DataFrame) -> DataFrame:
    """The rows of ``_ways`` by the names ``found`` and the nodes ``close`` (node_type, name, b)."""
    own = known.select("node_type", F.col("name").alias("other"), "to", "node_id", F.col("embedding").alias("w"))
    close = close.join(own.withColumnRenamed("node_id", "b").drop("node_type"), "b").select("node_type", "other", "name", "to", F.col("b").alias("node_id"), "w")
    found = found.join(own, ["node_type", "other"]).select(close.columns).unionByName(close).distinct().join(asked, ["node_type", "name"], "left")
    score = text.trigram_similarity(F.col("name"), F.col("other"))
    found = found.withColumn("distance", F.round(scores.cosine_distance(F.col("v"), F.col("w")), 12)).withColumn("similarity", F.round(score, 12))
    order = F.struct(F.col("distance").isNull(), "distance", -F.col("similarity"), "to")
    return found.select("node_type", "name", "to", "node_id", order.alias("order"))


def _one_after_another(existing: DataFrame, incoming: DataFrame, threshold: float, near: float) -> DataFrame:
    """node_type, name, node_id, change as if names came one by one, by ``seq``, each to the best of the known nodes and
    of those that names before it have made; it makes a node if there is none.

    A name makes a node if it has no known one to go to and no earlier name near it has made one. Rounds settle all
    names whose nearer ones are settled, so their number is that of the longest chain of names that wait for each
    other, and not that of names. Later occurrences of a name go where its first has gone; what a name adds to a node
    (a vector) is seen by the next batch.
    """
    vector = incoming["embedding"] if "embedding" in incoming.columns else F.lit(None)
    new = incoming.select("node_type", "name", vector.cast("array<double>").alias("embedding"), "seq")
    new = new.groupBy("node_type", "name").agg(F.min("seq").alias("seq"), F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("seq"))).alias("embedding"))
    new = written(new.withColumn("node_id", F.sha2(F.concat_ws("|", "node_type", "name"), 256)), "new-names")
    vector = existing["embedding"] if "embedding" in existing.columns else F.lit(None)
    known = existing.where("external_id is null").select("node_id", "node_type", "name", vector.cast("array<double>").alias("embedding"), F.coalesce("canonical_node_id", "node_id").alias("to"), F.lit(True).alias("old"))
    # made nodes are told from known ones of the same id
    made = new.select(F.concat(F.lit("new\x1f"), "node_id").alias("node_id"), "node_type", "name", "embedding", F.col("node_id").alias("to"), F.lit(False).alias("old"))
    held = known.unionByName(made)
    sides = held.select("node_type", "name").distinct()
    asked = new.select("node_type", "name")
    found = asked.join(known.select("node_type", "name").distinct(), ["node_type", "name"], "left_semi").withColumn("other", F.col("name"))
    found = found.unionByName(name_pairs(asked, threshold, sides).select("node_type", F.col("a").alias("name"), F.col("b").alias("other")))
    ways = _ways(held, new, found, near).join(new.select("node_type", "name", "seq", F.col("node_id").alias("own")), ["node_type", "name"])
    at = new.select(F.concat(F.lit("new\x1f"), "node_id").alias("node_id"), F.struct("seq", "node_id").alias("made_at"))
    ways = ways.join(at, "node_id", "left").where(F.col("made_at").isNull() | (F.col("made_at") < F.struct("seq", F.col("own").alias("node_id"))))
    ways = written(ways.select("node_type", "name", "own", "to", "order", F.col("made_at").isNull().alias("old")), "ways")

    settled = ways.where("old").select("own").distinct()
    waits = written(ways.where("not old").select("own", "to").join(settled, "own", "left_anti"), "waits")
    open_ = new.select(F.col("node_id").alias("own")).join(settled, "own", "left_anti")
    heads: list[DataFrame] = []
    merged = written(settled, "merged")
    while True:
        waits = written(waits.join(merged.withColumnRenamed("own", "to"), "to", "left_anti"), "waits")
        now = written(open_.join(waits.select("own"), "own", "left_anti"), "heads")
        heads.append(now)
        merged = written(waits.join(now.withColumnRenamed("own", "to"), "to", "left_semi").select("own").distinct(), "merged")
        open_ = written(open_.join(now, "own", "left_anti").join(merged, "own", "left_anti"), "open")
        if open_.isEmpty():
            break
        waits = waits.join(merged, "own", "left_anti")
    all_heads = reduce(DataFrame.unionByName, heads)
    best = ways.join(all_heads.withColumnRenamed("own", "to").withColumn("head", F.lit(True)), "to", "left").where("old or head").join(all_heads, "own", "left_anti")
    best = best.groupBy("node_type", "name").agg(F.min_by(F.struct("to", "old"), F.struct("order", ~F.col("old"))).alias("b"))
    gone = best.select("node_type", "name", F.col("b.to").alias("node_id"), F.when(F.col("b.old"), "enriched").otherwise("merged").alias("change"))
    return gone.unionByName(new.join(all_heads.withColumnRenamed("own", "node_id"), "node_id", "left_semi").select("node_type", "name", "node_id", F.lit("created").alias("change")))


def resolve_derived(existing: DataFrame, incoming: DataFrame, threshold: float = 0.55, near: float = 0.15, strategy: str = "components") -> DataFrame:
    """node_type, name, node_id, change for new names of derived nodes. ``strategy="sequential"`` gives what names give
    that come one after another, in rounds over all of them: chains don't merge, and a name goes to the best node there
    is at its turn, known or made before it. The default:

    First against known nodes; what is left is joined among itself into components by similarity of names or vectors,
    each represented by its first arrival (smallest ``seq``). Chains of similar names so become one node.
    """
    from .graphs import components

    if strategy not in ("components", "sequential"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy == "sequential":
        return _one_after_another(existing, incoming, threshold, near)
    matched = match_derived(existing, incoming, threshold, near)
    left = incoming.join(matched, ["node_type", "name"], "left_anti")
    key = lambda t, n: F.concat_ws("\x1f", t, n)
    vectors = left.where("embedding is not null").groupBy("node_type", "name").agg(F.min_by("embedding", "seq").alias("embedding")) if "embedding" in left.columns else None
    left = left.groupBy("node_type", "name").agg(F.min("seq").alias("seq"))
    links = name_pairs(left, threshold).select(key(F.col("node_type"), F.col("a")).alias("a"), key(F.col("node_type"), F.col("b")).alias("b"))
    if vectors is not None:
        links = links.unionByName(vector_pairs(vectors.withColumn("node_id", key(F.col("node_type"), F.col("name"))), near, same_type=True).select("a", "b"))
    left = left.withColumn("node", key(F.col("node_type"), F.col("name"))).join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = left.groupBy("component").agg(F.min_by("name", F.struct("seq", "name")).alias("head"))
    made = left.join(heads, "component").select("node_type", "name", F.sha2(F.concat_ws("|", "node_type", "head"), 256).alias("node_id"), F.when(F.col("name") == F.col("head"), "created").otherwise("merged").alias("change"))
    return matched.select("node_type", "name", F.col("matched_id").alias("node_id"), F.lit("enriched").alias("change")).unionByName(made)


def resolve_edges(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Extracted edges (document_id, source_temp, target_temp, ...) with node ids; those that dangle are dropped."""
    a = ids.select("document_id", F.col("temp_id").alias("source_temp"), F.col("node_id").alias("source_id"))
    b = ids.select("document_id", F.col("temp_id").alias("target_temp"), F.col("node_id").alias("target_id"))
    return found.join(a, ["document_id", "source_temp"]).join(b, ["document_id", "target_temp"]).drop("source_temp", "target_temp")


def redirect_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ends replaced by ``mapping`` (old_id, new_id); loops go, existing edges win over redirected ones,
    which lose their evidence."""
    a, b = (mapping.select(F.col("old_id").alias(c), F.col("new_id").alias(f"_{c}")) for c in ("source_id", "target_id"))
    moved = edges.join(a, "source_id", "left").join(b, "target_id", "left")
    changed = F.col("_source_id").isNotNull() | F.col("_target_id").isNotNull()
    moved = moved.withColumns({"source_id": F.coalesce("_source_id", "source_id"), "target_id": F.coalesce("_target_id", "target_id"), "_moved": changed})
    moved = moved.withColumn("evidence_document_id", F.when(~F.col("_moved"), F.col("evidence_document_id"))).where(~F.col("_moved") | (F.col("source_id") != F.col("target_id")))
    order = Window.partitionBy(*EDGE_KEY).orderBy("_moved", F.col("weight").desc(), F.col("confidence").desc())
    return moved.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(edges.columns)


def wikilink_mapping(files: DataFrame, concepts: DataFrame) -> DataFrame:
    """(old_id, new_id): concepts whose slug is that of a file's name; of several files the smallest id."""
    own = files.select(text.slugify(F.col("name")).alias("slug"), "node_id").where("slug <> ''").groupBy("slug").agg(F.min("node_id").alias("new_id"))
    return concepts.select(F.col("node_id").alias("old_id"), text.slugify(F.col("name")).alias("slug")).distinct().join(own, "slug").select("old_id", "new_id")


def last_cursor(runs: DataFrame) -> DataFrame:
    """Per source and resource the cursor of the newest completed run that has one."""
    done = runs.where("status = 'completed' and cursor is not null")
    return done.groupBy("source_system", "resource_key").agg(F.max_by("cursor", F.struct("started_at", "run_id")).alias("cursor"))


def incremental(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items at or after the cursor of their resource; all of a resource without one."""
    return items.join(last_cursor(runs), ["source_system", "resource_key"], "left").where("cursor is null or item_cursor >= cast(cursor as bigint)").drop("cursor")
