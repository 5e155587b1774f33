"""Search, walks, PageRank, similarity joins, extraction, resolution, scans and proposals over the lens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scores, stems, text
from ..lens import Lens
from ..operators import extract, graphs, proposals, resolve, scans, search
from ..session import written
from . import blocks
from .registry import query
from .scalars import summarize_proposal

_BAG = "map<string,string>"
_P = blocks.PROPOSALS


def _no_bag() -> Column:
    return F.create_map().cast(_BAG)


# --- search


def _vector_queries(g: Lens) -> DataFrame:
    """The query vectors: those whose id is divisible by 20."""
    return g.table("embeddings").where("vec_id % 20 = 0").select(F.concat(F.lit("q"), "vec_id").alias("request_id"), "embedding")


_SEMANTIC = """, q AS (SELECT 'q' || vec_id AS request_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
 sem AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, node_id) AS rank, node_id, similarity FROM (SELECT request_id, 'vec:' || vec_id AS node_id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS similarity FROM embeddings, q))
"""


@query(_SEMANTIC + "SELECT * FROM sem WHERE rank <= 10")
def semantic_search(g: Lens) -> DataFrame:
    return search.semantic_search(g.vectors, _vector_queries(g), 10)


@query(_SEMANTIC + "SELECT request_id, node_id, similarity FROM sem WHERE rank <= 20")
def topk_cosine(g: Lens) -> DataFrame:
    return search.semantic_search(g.vectors, _vector_queries(g), 20).select("request_id", "node_id", "similarity")


_STOP = "[" + ", ".join(f"'{w}'" for w in stems.STOP_WORDS) + "]"
_KEYWORDS = f""", k0 AS (SELECT p_partkey, p_name AS name, list_transform(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains({_STOP}, w)), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(?:ing|ed|es|s)$', '') ELSE w END) AS t FROM part),
"""


_FOUND = _KEYWORDS + """ kw AS (SELECT row_number() OVER (ORDER BY score DESC, name, node_id) AS rank, node_id, name, score FROM (
 SELECT 'part:' || p_partkey AS node_id, name, round((CASE WHEN p > 0 THEN 1 + ln(p) ELSE 0 END + CASE WHEN e > 0 THEN 1 + ln(e) ELSE 0 END) / (1 + ln(1.0 + len(t))), 6)::DOUBLE AS score
 FROM (SELECT *, len(list_filter(t, lambda x: x = 'promo')) AS p, len(list_filter(t, lambda x: x = 'economy')) AS e FROM k0) WHERE p > 0 OR (e > 0 AND NOT list_contains(t, 'copper'))))
"""
_KEYWORD_QUERY = "PROMO OR ECONOMY -copper"


def _part_body() -> Column:
    return F.concat_ws(" ", "name", F.try_element_at("properties", F.lit("brand")), F.try_element_at("properties", F.lit("type")))


@query(_FOUND + "SELECT * FROM kw WHERE rank <= 20")
def keyword_search(g: Lens) -> DataFrame:
    return search.keyword_search(g.parts, _KEYWORD_QUERY, 20, _part_body())


@query(_FOUND + "SELECT rank, node_id, score FROM kw WHERE rank <= 50")
def topk_keyword(g: Lens) -> DataFrame:
    index = search.index_words(g.parts.select("node_id", "name", _part_body().alias("body")))
    return search.search_words(index, _KEYWORD_QUERY, 50).select("rank", "node_id", "score")


def _legs(g: Lens) -> tuple[DataFrame, DataFrame]:
    """Each query vector together with the words of its label."""
    sem = search.semantic_search(g.vectors, _vector_queries(g), 20)
    e = g.table("embeddings")
    named = e.select(F.concat(F.lit("vec:"), "vec_id").alias("node_id"), F.concat(F.lit("vec "), "vec_id", F.lit(" label "), "label").alias("name")).withColumn("body", F.col("name"))
    asked = e.where("vec_id % 20 = 0").select(F.concat(F.lit("q"), "vec_id").alias("request_id"), F.concat(F.lit("label "), "label").alias("query"))
    return sem, search.keyword_batch(named, asked, 20)


_LEGS = _SEMANTIC + """, kwv AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, name, node_id) AS rank, node_id FROM (SELECT 'q' || y.vec_id AS request_id, 'vec:' || x.vec_id AS node_id, 'vec ' || x.vec_id || ' label ' || x.label AS name, round((1.0 + 1 + CASE WHEN x.label = y.label AND x.vec_id = y.label THEN ln(2) ELSE 0 END) / (1 + ln(5.0)), 6) AS score
  FROM embeddings x JOIN embeddings y ON x.label = y.label OR x.vec_id = y.label WHERE y.vec_id % 20 = 0)),
 legs AS (SELECT request_id, node_id, 's' AS leg, rank FROM sem WHERE rank <= 20 UNION ALL SELECT request_id, node_id, 'k', rank FROM kwv WHERE rank <= 20)
"""


@query(_LEGS + ", fused AS (SELECT request_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(rank) FILTER (WHERE leg = 's') AS semantic_rank, min(rank) FILTER (WHERE leg = 'k') AS keyword_rank FROM legs GROUP BY 1, 2) SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, semantic_rank NULLS LAST, keyword_rank NULLS LAST, node_id) <= 20")
def hybrid_search(g: Lens) -> DataFrame:
    return search.fuse(*_legs(g), 20)


@query(_LEGS + "SELECT * FROM legs")
def win_rank_legs(g: Lens) -> DataFrame:
    sem, kw = _legs(g)
    return sem.select("request_id", "node_id", F.lit("s").alias("leg"), "rank").unionByName(kw.select("request_id", "node_id", F.lit("k").alias("leg"), "rank"))


@query(_LEGS + "SELECT request_id, node_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM legs GROUP BY 1, 2")
def set_union_legs(g: Lens) -> DataFrame:
    return search.fuse(*_legs(g), 1 << 20).select("request_id", "node_id", "score")


@query("""SELECT node_id, coalesce(neighbors, []) AS neighbors, coalesce(systems, []) AS systems FROM (SELECT node_id FROM n_customer)
 LEFT JOIN (SELECT node_id, list_sort(list(direction || ' ' || relationship || ' ' || other_id)) AS neighbors FROM (SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY relationship, other_id) AS k FROM (
  SELECT source_id AS node_id, 'out' AS direction, relationship, target_id AS other_id FROM (SELECT * FROM e_member_of UNION ALL SELECT * FROM e_authored))) WHERE k <= 5 GROUP BY 1) USING (node_id)
 LEFT JOIN (SELECT node_id, list_sort(list(DISTINCT source_system)) AS systems FROM mentions JOIN event_docs USING (document_id) GROUP BY 1) USING (node_id)""")
def ask(g: Lens) -> DataFrame:
    return search.ask(g.nodes("customer"), g.nodes("nation", "order"), g.edges("MEMBER_OF", "AUTHORED"), g.mentions, g.event_docs)


# --- walks


def _starts(g: Lens) -> DataFrame:
    """All suppliers."""
    return g.nodes("supplier").select(F.col("node_id").alias("start_id"))


_ADJ = """, adj AS (SELECT source_id AS near, target_id AS far, '>' || relationship AS step FROM (SELECT * FROM e_part_of UNION ALL SELECT * FROM e_member_of) UNION SELECT target_id, source_id, '<' || relationship FROM (SELECT * FROM e_part_of UNION ALL SELECT * FROM e_member_of)),
 names AS (SELECT node_id, name, node_type FROM n_region UNION ALL SELECT node_id, name, node_type FROM n_nation UNION ALL SELECT node_id, name, node_type FROM n_customer UNION ALL SELECT node_id, name, node_type FROM n_supplier),
 s AS (SELECT node_id AS start_id FROM n_supplier),
 w1 AS (SELECT start_id, far AS node_id, [step] AS rels, [a.name, b.name] AS names FROM s JOIN names a ON a.node_id = start_id JOIN adj ON near = start_id JOIN names b ON b.node_id = far),
 w2 AS (SELECT start_id, far AS node_id, min((list_append(rels, step), list_append(names, n.name))) AS p FROM w1 JOIN adj ON near = w1.node_id JOIN names n ON n.node_id = far WHERE far <> start_id AND (start_id, far) NOT IN (SELECT (start_id, node_id) FROM w1) GROUP BY 1, 2),
 found AS (SELECT start_id, node_id, 1 AS depth, rels, names FROM w1 UNION ALL SELECT start_id, node_id, 2, p[1], p[2] FROM w2),
 paths AS (SELECT start_id, node_id, depth, names[1] || list_aggregate(list_transform(range(1, len(rels) + 1), lambda i: CASE WHEN rels[i][1:1] = '>' THEN ' -[' || rels[i][2:] || ']-> ' ELSE ' <-[' || rels[i][2:] || ']- ' END || names[i + 1]), 'string_agg', '') AS path FROM found)
"""


def _world(g: Lens) -> tuple[DataFrame, DataFrame]:
    return g.edges("PART_OF", "MEMBER_OF"), g.nodes("region", "nation", "customer", "supplier")


@query(_ADJ + "SELECT start_id, node_id, depth, path FROM (SELECT p.*, row_number() OVER (PARTITION BY start_id ORDER BY depth, node_id) AS k FROM paths p JOIN names USING (node_id) WHERE node_type = 'customer') WHERE k <= 10")
def traverse_to_type(g: Lens) -> DataFrame:
    edges, nodes = _world(g)
    return graphs.traverse_to_type(edges, nodes, _starts(g), "customer", 2, 10)


@query(""", e AS (SELECT * FROM e_depends_on WHERE confidence >= 1 UNION ALL SELECT * FROM e_member_of WHERE source_id LIKE 'supplier:%'),
 adj AS (SELECT source_id AS near, target_id AS far, '>' || relationship AS step FROM e UNION SELECT target_id, source_id, '<' || relationship FROM e),
 names AS (SELECT node_id, name FROM n_part UNION ALL SELECT node_id, name FROM n_nation UNION ALL SELECT node_id, name FROM n_supplier),
 w1 AS (SELECT s.node_id AS start_id, far AS node_id, 1 AS depth, [step] AS rels, [s.name, n.name] AS names FROM n_supplier s JOIN adj ON near = s.node_id JOIN names n ON n.node_id = far),
 w2 AS (SELECT start_id, far AS node_id, 2 AS depth, list_append(rels, step) AS rels, list_append(names, n.name) AS names FROM w1 JOIN adj ON near = w1.node_id JOIN names n ON n.node_id = far WHERE far <> start_id)
 SELECT start_id, node_id, depth, names[1] || list_aggregate(list_transform(range(1, len(rels) + 1), lambda i: CASE WHEN rels[i][1:1] = '>' THEN ' -[' || rels[i][2:] || ']-> ' ELSE ' <-[' || rels[i][2:] || ']- ' END || names[i + 1]), 'string_agg', '') AS path FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2)""")
def all_paths(g: Lens) -> DataFrame:
    """Every simple path of two steps from suppliers, over untaxed deliveries and nations."""
    edges = g.edges("DEPENDS_ON").where("confidence >= 1").unionByName(g.edges("MEMBER_OF").where("source_id like 'supplier:%'"))
    found = graphs.simple_paths(edges, g.nodes("part", "nation", "supplier"), _starts(g), 2, most_rows=1 << 40).where("depth > 0")
    return found.select("start_id", "node_id", "depth", text.render_path(F.col("names"), F.col("rels")).alias("path"))


@query(_ADJ + "SELECT start_id, node_id, depth FROM paths ORDER BY depth, start_id, node_id LIMIT 15")
def topk_paths(g: Lens) -> DataFrame:
    edges, nodes = _world(g)
    found = graphs.first_arrivals(edges, nodes, _starts(g), 2, enough=15).where("depth > 0")
    return found.orderBy("depth", "start_id", "node_id").limit(15).select("start_id", "node_id", "depth")


@query(_ADJ + "SELECT start_id, node_id, depth, path FROM paths")
def win_distinct_on_shortest(g: Lens) -> DataFrame:
    edges, nodes = _world(g)
    found = graphs.first_arrivals(edges, nodes, _starts(g), 2).where("depth > 0")
    return found.select("start_id", "node_id", "depth", text.render_path(F.col("names"), F.col("rels")).alias("path"))


@query(_ADJ + """, pairs AS (SELECT DISTINCT 'supplier:' || l_suppkey AS start_id, 'customer:' || o_custkey AS target_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
 SELECT paths.start_id, target_id, depth, path FROM paths JOIN pairs ON pairs.start_id = paths.start_id AND target_id = node_id""")
def find_path(g: Lens) -> DataFrame:
    """From suppliers to the customers whom they have served, within two steps."""
    edges, nodes = _world(g)
    served = g.table("lineitem").join(g.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = served.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("start_id"), F.concat(F.lit("customer:"), "o_custkey").alias("target_id"))
    return graphs.find_path(edges, nodes, pairs, 2)


_HOPS = """, adj AS (SELECT source_id AS near, target_id AS far FROM (SELECT * FROM e_part_of UNION ALL SELECT * FROM e_member_of) UNION SELECT target_id, source_id FROM (SELECT * FROM e_part_of UNION ALL SELECT * FROM e_member_of)),
 h0 AS (SELECT node_id AS start_id, node_id, 0 AS depth FROM n_supplier),
 h1 AS (SELECT * FROM h0 UNION ALL SELECT start_id, far, 1 FROM h0 JOIN adj ON near = node_id),
 h2 AS (SELECT * FROM h1 UNION ALL SELECT start_id, far, 2 FROM h1 JOIN adj ON near = node_id),
 hops AS (SELECT start_id, node_id, min(depth) AS depth FROM h2 GROUP BY 1, 2)
"""


@query(_HOPS + "SELECT * FROM hops")
def khop_nodes(g: Lens) -> DataFrame:
    return graphs.khop_nodes(g.edges("PART_OF", "MEMBER_OF"), _starts(g), 2)


@query(_HOPS + """, met AS (SELECT start_id, source_id, relationship, target_id, min(depth) AS d FROM (SELECT * FROM e_part_of UNION ALL SELECT * FROM e_member_of) e JOIN hops ON node_id IN (source_id, target_id) WHERE depth <= 1 GROUP BY ALL),
 label AS (SELECT node_id, '"' || translate(name, '"[]', chr(39) || '()') || ' (' || node_type || ')"' AS label FROM nodes)
 SELECT start_id, rank, a.label AS source, relationship, b.label AS target FROM (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY d, source_id, relationship, target_id) AS rank FROM met) m JOIN label a ON a.node_id = source_id JOIN label b ON b.node_id = target_id WHERE rank <= 40""")
def khop_subgraph(g: Lens) -> DataFrame:
    edges, nodes = _world(g)
    return graphs.khop_subgraph(edges, nodes, _starts(g), 2, 40)


@query("SELECT r.target_id AS start_id, r.source_id AS n1, m.source_id AS n2 FROM e_part_of r JOIN e_member_of m ON m.target_id = r.source_id")
def set_union_all_walk(g: Lens) -> DataFrame:
    """A bounded walk as recursive SQL."""
    steps = g.edges("PART_OF", "MEMBER_OF").select("source_id", "target_id")
    return g.spark.sql("""
        WITH RECURSIVE walk(path, node, depth) AS (
            SELECT array(target_id), target_id, 0 FROM (SELECT DISTINCT target_id FROM {steps} WHERE target_id LIKE 'region:%')
            UNION ALL SELECT concat(path, array(source_id)), source_id, depth + 1 FROM walk JOIN {steps} ON target_id = node WHERE depth < 2)
        SELECT path[0] AS start_id, path[1] AS n1, path[2] AS n2 FROM walk WHERE depth = 2""", steps=steps)


@query("SELECT DISTINCT d.source_id AS n0, d.target_id AS n1, m.target_id AS n2, r.target_id AS n3 FROM e_depends_on d JOIN e_member_of m ON m.source_id = d.target_id JOIN e_part_of r ON r.source_id = m.target_id")
def match_pattern(g: Lens) -> DataFrame:
    return blocks.match_pattern(g.edges("DEPENDS_ON", "MEMBER_OF", "PART_OF"), [("DEPENDS_ON", ">"), ("MEMBER_OF", ">"), ("PART_OF", ">")])


_RANKS = """, nn AS MATERIALIZED (SELECT node_id FROM n_region UNION ALL SELECT node_id FROM n_nation UNION ALL SELECT node_id FROM n_supplier UNION ALL SELECT node_id FROM n_customer),
 ee AS MATERIALIZED (SELECT source_id, target_id FROM e_part_of UNION ALL SELECT source_id, target_id FROM e_member_of), od AS (SELECT source_id AS node_id, count(*) AS o FROM ee GROUP BY 1),
 r0 AS (SELECT node_id, 1.0::DOUBLE / (SELECT count(*) FROM nn) AS rank FROM nn)"""
for _k in range(30):
    _RANKS += f""",
 r{_k + 1} AS MATERIALIZED (SELECT node_id, 0.15::DOUBLE / (SELECT count(*) FROM nn) + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{_k} ANTI JOIN od USING (node_id)) / (SELECT count(*) FROM nn) + 0.85::DOUBLE * coalesce(got, 0) AS rank
  FROM nn LEFT JOIN (SELECT target_id AS node_id, sum(rank / o) AS got FROM ee JOIN r{_k} ON r{_k}.node_id = source_id JOIN od ON od.node_id = source_id GROUP BY 1) USING (node_id))"""


@query(_RANKS + " SELECT node_id, round(rank / (SELECT max(rank) FROM r30), 4) AS rank FROM r30")
def pagerank(g: Lens) -> DataFrame:
    """Thirty rounds over the places and who belongs to them."""
    edges, nodes = _world(g)
    return graphs.pagerank(nodes, edges)


@query(_RANKS + " SELECT node_id, name, round(rank / (SELECT max(rank) FROM r30), 4)::VARCHAR AS importance FROM r30 JOIN nodes USING (node_id)")
def stamp_importance(g: Lens) -> DataFrame:
    edges, nodes = _world(g)
    ranks = graphs.pagerank(nodes, edges)
    own = nodes.where("canonical_node_id is null").join(ranks, "node_id")
    return own.withColumn("properties", scores.stamp(F.col("properties"), "importance", F.col("rank"))).select("node_id", "name", F.try_element_at("properties", F.lit("importance")).alias("importance"))


@query()
def pagerank_all(g: Lens) -> DataFrame:
    """Thirty rounds over all nodes and edges, as the reference ranks; a brute-force test instead of SQL."""
    return graphs.pagerank(g.nodes(), g.edges())


@query()
def stamp_importance_all(g: Lens) -> DataFrame:
    """The same ranks on all canonical nodes."""
    own = g.nodes().where("canonical_node_id is null").join(graphs.pagerank(g.nodes(), g.edges()), "node_id")
    return own.withColumn("properties", scores.stamp(F.col("properties"), "importance", F.col("rank"))).select("node_id", "name", F.try_element_at("properties", F.lit("importance")).alias("importance"))


# --- similarity joins

_PART_TRI = """, dn AS (SELECT DISTINCT p_name AS name FROM part), tg AS (SELECT name, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3))))) AS g FROM dn),
 np AS (SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM tg a JOIN tg b ON a.name < b.name)
"""


@query(_PART_TRI + "SELECT * FROM np WHERE similarity >= 0.45")
def self_fuzzy_pairs(g: Lens) -> DataFrame:
    return resolve.name_pairs(g.parts, 0.45).select("a", "b", F.round("similarity", 6).alias("similarity"))


_VEC = """, vp AS (SELECT least('vec:' || a.vec_id, 'vec:' || b.vec_id) AS a, greatest('vec:' || a.vec_id, 'vec:' || b.vec_id) AS b, a.label AS la, b.label AS lb, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
"""


@query(_VEC + "SELECT a, b, distance FROM vp WHERE distance <= 0.6")
def knn_join(g: Lens) -> DataFrame:
    return resolve.vector_pairs(g.vectors, 0.6, places=6).select("a", "b", "distance")


def _vec_mentions(g: Lens) -> DataFrame:
    """Two mentions of each vector."""
    e = g.table("embeddings").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return e.select(F.concat(F.lit("vec:"), "vec_id").alias("node_id"), F.concat(F.lit("m:"), "vec_id", F.lit(":"), "n").alias("document_id"))


def _vec_edges(g: Lens) -> DataFrame:
    e = g.table("embeddings")
    return e.select(F.concat(F.lit("vec:"), "vec_id").alias("source_id"), F.concat(F.lit("vec:"), F.col("vec_id") + 3).alias("target_id"), F.lit("RELATES_TO").alias("relationship"))


_LINKABLE = "abs(split_part(a, ':', 2)::INT - split_part(b, ':', 2)::INT) <> 3"


@query(_VEC + f"SELECT a, b, distance FROM vp WHERE distance <= 0.65 AND {_LINKABLE}")
def self_vector_pairs_no_edge(g: Lens) -> DataFrame:
    return scans.link_candidates(g.vectors, _vec_mentions(g), _vec_edges(g), 0.65, places=6).select("a", "b", "distance")


@query(_VEC + f"SELECT 'edge_add' AS kind, a || ':' || b AS dedup_key, 0.75::DOUBLE AS confidence FROM vp WHERE distance <= 0.65 AND {_LINKABLE} AND (split_part(a, ':', 2)::INT + split_part(b, ':', 2)::INT) % 2 = 0")
def scan_link_prediction(g: Lens) -> DataFrame:
    near = scans.link_candidates(g.vectors, _vec_mentions(g), _vec_edges(g), 0.65, places=6)
    number = lambda c: F.split_part(c, F.lit(":"), F.lit(2)).cast("int")
    said = near.select(F.concat_ws(":", "a", "b").alias("dedup_key"), F.lit("RELATES_TO").alias("relationship"), F.when((number("a") + number("b")) % 2 == 0, 0.75).otherwise(0.2).alias("judged"))
    found = scans.scan_link_prediction(g.vectors, _vec_mentions(g), _vec_edges(g), said, extract.seed_relationships(g.spark), 0.65, None, places=6)
    return found.select("kind", "dedup_key", "confidence")


@query(_PART_TRI + """, own AS (SELECT 'part:' || min(p_partkey) AS node_id, p_name AS name, min(p_partkey) AS k FROM part GROUP BY 2)
 SELECT least(x.node_id, y.node_id) || ':' || greatest(x.node_id, y.node_id) AS dedup_key, CASE WHEN x.k % 2 = 0 AND y.k % 2 <> 0 THEN x.node_id WHEN y.k % 2 = 0 AND x.k % 2 <> 0 THEN y.node_id ELSE least(x.node_id, y.node_id) END AS winner_id, round(similarity, 3) AS confidence
 FROM np JOIN own x ON x.name = a JOIN own y ON y.name = b WHERE similarity >= 0.45 AND NOT (x.k % 2 = 0 AND y.k % 2 = 0)""")
def scan_dedup(g: Lens) -> DataFrame:
    """Parts of even keys are sourced, the others derived."""
    even = F.split_part("node_id", F.lit(":"), F.lit(2)).cast("long") % 2 == 0
    nodes = g.parts.withColumns({"source_system": F.when(even, F.col("source_system")), "external_id": F.when(even, F.col("external_id"))})
    found = scans.scan_dedup(nodes, g.mentions, name_at=0.45, limit=None)
    return found.select("dedup_key", F.try_element_at("payload", F.lit("winner_id")).alias("winner_id"), F.round("confidence", 3).alias("confidence"))


@query(_PART_TRI + "SELECT a, b, round(similarity, 6) AS name_similarity FROM np WHERE similarity >= 0.45 ORDER BY name_similarity DESC, a, b LIMIT 5")
def topk_candidates(g: Lens) -> DataFrame:
    pairs = resolve.name_pairs(g.parts, 0.45).select("a", "b", F.round("similarity", 6).alias("name_similarity"))
    return pairs.orderBy(F.col("name_similarity").desc_nulls_last(), "a", "b").limit(5)


@query("SELECT 'customer:' || c.c_custkey AS a, 'customer:' || (c.c_custkey + 1) AS b, CASE WHEN coalesce(x.n, 0) >= coalesce(y.n, 0) AND (coalesce(x.n, 0) > coalesce(y.n, 0) OR 'customer:' || c.c_custkey <= 'customer:' || (c.c_custkey + 1)) THEN 'customer:' || c.c_custkey ELSE 'customer:' || (c.c_custkey + 1) END AS winner_id FROM customer c JOIN customer d ON d.c_custkey = c.c_custkey + 1 LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) x ON x.user_id = c.c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) y ON y.user_id = d.c_custkey")
def win_pick_winner(g: Lens) -> DataFrame:
    c = g.table("customer")
    pairs = c.select(F.concat(F.lit("customer:"), "c_custkey").alias("a"), F.concat(F.lit("customer:"), F.col("c_custkey") + 1).alias("b"))
    return scans.pick_winner(pairs, g.nodes("customer"), g.mentions).select("a", "b", "winner_id")


@query(_PART_TRI + """, j AS (SELECT a || ':' || b AS dedup_key, similarity, ['same', 'different', 'unsure'][length(a || b) % 3 + 1] AS verdict FROM np WHERE similarity >= 0.45)
 SELECT dedup_key, round(CASE verdict WHEN 'same' THEN greatest(round(similarity, 3), 0.9) WHEN 'different' THEN least(round(similarity, 3), 0.4) ELSE round(similarity, 3) END, 3)::DOUBLE AS score FROM j""")
def judge_pairs(g: Lens) -> DataFrame:
    import pandas as pd

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        verdict = pdf["dedup_key"].map(lambda k: ["same", "different", "unsure"][(len(k) - 1) % 3])
        return pd.DataFrame({"dedup_key": pdf["dedup_key"], "verdict": verdict, "judged": verdict.map({"same": 0.9, "different": 0.6, "unsure": 0.0})})

    pairs = resolve.name_pairs(g.parts, 0.45).select(F.concat_ws(":", "a", "b").alias("dedup_key"), F.round("similarity", 6).alias("similarity"))
    said = extract.judge_pairs(pairs.select("dedup_key"), judge)
    return pairs.join(said, "dedup_key").select("dedup_key", F.round(scores.judge_confidence(F.round("similarity", 3), F.col("verdict"), F.col("judged")), 3).alias("score"))


# --- scans


@query(", q AS (SELECT node_id, max(source_updated_at) AS last_seen FROM mentions JOIN event_docs USING (document_id) WHERE source_system = 'purchase' GROUP BY 1 HAVING max(source_updated_at) < TIMESTAMP '2024-01-29') SELECT node_id || ':' || strftime(last_seen, '%Y-%m-%d') AS dedup_key, 'no evidence for ''' || c_name || ''' in ' || ((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_seen)) // 86400000000) || ' days' AS reason, round(least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (greatest(0, ((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last_seen)) // 86400000000) - 3) / 1.5)), 3)::DOUBLE AS confidence FROM q JOIN customer ON node_id = 'customer:' || c_custkey WHERE c_acctbal >= 0")
def scan_staleness(g: Lens) -> DataFrame:
    found = scans.scan_staleness(g.nodes("customer"), g.mentions, g.event_docs.where("source_system = 'purchase'"), g.now, 3, None)
    return found.select("dedup_key", F.try_element_at("payload", F.lit("reason")).alias("reason"), "confidence")


@query("SELECT node_id FROM nodes WHERE canonical_node_id IS NULL AND node_id NOT IN (SELECT source_id FROM edges UNION ALL SELECT target_id FROM edges UNION ALL SELECT node_id FROM mentions UNION ALL SELECT canonical_node_id FROM nodes WHERE canonical_node_id IS NOT NULL)")
def anti_orphans(g: Lens) -> DataFrame:
    return scans.orphans(g.nodes(), g.edges(), g.mentions).select("node_id")


@query("SELECT node_id AS dedup_key, 'node_removal' AS kind, 0.7::DOUBLE AS confidence FROM nodes WHERE canonical_node_id IS NULL AND node_id NOT IN (SELECT source_id FROM edges UNION ALL SELECT target_id FROM edges UNION ALL SELECT node_id FROM mentions UNION ALL SELECT canonical_node_id FROM nodes WHERE canonical_node_id IS NOT NULL) ORDER BY node_id LIMIT 100")
def scan_orphans(g: Lens) -> DataFrame:
    return scans.scan_orphans(g.nodes(), g.edges(), g.mentions).select("dedup_key", "kind", "confidence")


@query(_P + ", found AS (SELECT 'stale_flag' AS kind, 'stale_flag:' || c_custkey AS dedup_key, c_acctbal, c_custkey FROM customer) SELECT dedup_key FROM found ANTI JOIN proposals USING (kind, dedup_key) ORDER BY c_acctbal, c_custkey LIMIT 20")
def scan_unfiled(g: Lens) -> DataFrame:
    """What the queue has under any status takes no room among the first twenty."""
    found = g.table("customer").select(F.concat(F.lit("stale_flag:"), "c_custkey").alias("dedup_key"), "c_acctbal", "c_custkey")
    return scans.unfiled(found, "stale_flag", _queue(g), 20, ["c_acctbal", "c_custkey"]).select("dedup_key")


@query("SELECT 'edge_removal' AS kind, source_id || ':' || relationship || ':' || target_id AS dedup_key FROM e_references WHERE confidence < 0.93")
def scan_weak_edges(g: Lens) -> DataFrame:
    return scans.scan_weak_edges(g.edges("REFERENCES"), 0.93, None).select("kind", "dedup_key")


@query("SELECT 'part:' || a.first_key || ':part:' || a.p_partkey || ':' || k AS dedup_key, CASE k WHEN 'brand' THEN b.p_brand ELSE b.p_type END AS value, CASE k WHEN 'brand' THEN a.p_brand ELSE a.p_type END AS alias_value FROM parts a JOIN part b ON b.p_partkey = a.first_key, (VALUES ('brand'), ('type')) v(k) WHERE a.first_key <> a.p_partkey AND CASE k WHEN 'brand' THEN b.p_brand <> a.p_brand ELSE b.p_type <> a.p_type END")
def scan_contradictions(g: Lens) -> DataFrame:
    found = scans.scan_contradictions(g.parts, None)
    return found.select("dedup_key", *(F.try_element_at("payload", F.lit(k)).alias(k) for k in ("value", "alias_value")))


# --- extraction, resolution, upserts


def _href_docs(g: Lens) -> DataFrame:
    p = g.table("pages")
    return p.select(F.concat(F.lit("page:"), "page_id").alias("document_id"), F.lit("web").alias("source_system"), F.lit("page").alias("source_type"), F.col("page_id").cast("string").alias("external_id"), F.col("url").alias("title"), F.col("html").alias("content"))


def _hrefs() -> Column:
    return F.array_distinct(F.regexp_extract_all("content", F.lit('href="([^"]*)"'), F.lit(1)))


@query(", l AS (SELECT page_id, count(DISTINCT href) AS n FROM hrefs GROUP BY 1) SELECT 'page:' || page_id AS document_id, coalesce(n, 0) + 1 AS n_nodes, coalesce(n, 0) AS n_edges FROM pages LEFT JOIN l USING (page_id)")
def extract_rules(g: Lens) -> DataFrame:
    got = extract.extract_rules(_href_docs(g), _hrefs())
    return got.select("document_id", F.size("nodes").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"))


def _extracted(g: Lens) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extracted nodes and edges of pages, and ids for temporary ids."""
    got = extract.extract_rules(_href_docs(g), _hrefs())
    nodes = got.select("document_id", F.inline("nodes"))
    ids = nodes.select("document_id", "temp_id", F.when(F.col("temp_id") == "doc", F.col("document_id")).otherwise(F.concat(F.lit("concept:"), "name")).alias("node_id"))
    return nodes, got.select("document_id", F.inline("edges")), ids


@query("SELECT DISTINCT 'page:' || page_id AS source_id, 'concept:' || href AS target_id, 'REFERENCES' AS relationship FROM hrefs")
def resolve_edges(g: Lens) -> DataFrame:
    _, edges, ids = _extracted(g)
    return resolve.resolve_edges(edges, ids).select("source_id", "target_id", "relationship")


@query("""SELECT 'supplier:' || l_suppkey AS source_id, 'part:' || l_partkey AS target_id, count(*)::DOUBLE AS weight, max(l_quantity)::DOUBLE AS confidence,
 arg_max('order:' || l_orderkey, l_orderkey * 10 + l_linenumber) AS evidence, arg_max(l_linenumber::VARCHAR, l_orderkey * 10 + l_linenumber) AS line FROM lineitem GROUP BY 1, 2""")
def edge_ledger(g: Lens) -> DataFrame:
    """Who supplies what, seen in three batches of orders; the first comes again after the last."""
    seen = g.table("lineitem").select(
        F.concat(F.lit("supplier:"), "l_suppkey").alias("source_id"), F.concat(F.lit("part:"), "l_partkey").alias("target_id"), F.lit("SUPPLIES").alias("relationship"), F.col("l_quantity").cast("double").alias("confidence"),
        F.concat(F.lit("order:"), "l_orderkey").alias("evidence_document_id"), F.create_map(F.lit("line"), F.col("l_linenumber").cast("string")).alias("properties"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_orderkey") % 3).alias("batch"),
    )
    ledger = None
    for batch in (0, 1, 2, 0):
        ledger = written(resolve.record_edges(ledger, seen.where(F.col("batch") == batch).drop("batch"), f"batch {batch}"), "edge-ledger")
    return resolve.edges_of(ledger).select("source_id", "target_id", "weight", "confidence", F.col("evidence_document_id").alias("evidence"), F.try_element_at("properties", F.lit("line")).alias("line"))


@query("SELECT 'page:' || page_id AS document_id, length(html) AS n FROM pages")
def extract_model(g: Lens) -> DataFrame:
    """A provider that reports the length of what it is shown as an entity's name."""
    docs = _href_docs(g).select("document_id", F.col("content").alias("rendered"))
    got = extract.extract_model(docs, lambda i, t: {"nodes": [{"temp_id": "x", "node_type": "document", "name": str(len(t)), "summary": None, "source_system": None, "external_id": None, "confidence": 1.0}]})
    return got.select("document_id", F.element_at("nodes", 1)["name"].cast("long").alias("n"))


@query("SELECT 'page:' || page_id AS document_id, 0::INT AS n_nodes FROM pages")
def udtf_provider_extract(g: Lens) -> DataFrame:
    """A provider that finds nothing gives every document an empty result."""
    docs = _href_docs(g).select("document_id", F.col("content").alias("rendered"))
    return extract.extract_model(docs, lambda i, t: {}).select("document_id", F.size("nodes").alias("n_nodes"))


@query("SELECT node_id, CASE WHEN node_type NOT IN ('document', 'user') THEN 'unknown type' WHEN k % 7 = 0 THEN 'confidence' WHEN k % 5 = 0 THEN 'half sourced' END AS error FROM (SELECT node_id, external_id::BIGINT AS k, CASE WHEN external_id::BIGINT % 3 = 0 THEN 'planet' ELSE 'document' END AS node_type FROM n_customer)")
def validate_extraction(g: Lens) -> DataFrame:
    k = F.col("external_id").cast("long")
    nodes = g.nodes("customer").select("node_id", F.when(k % 3 == 0, "planet").otherwise("document").alias("node_type"), F.when(k % 7 == 0, 1.5).otherwise(0.5).alias("confidence"), F.when(k % 5 != 0, F.col("source_system")).alias("source_system"), "external_id")
    return extract.validate_nodes(nodes, extract.seed_node_types(g.spark)).select("node_id", "error")


@query("SELECT node_id FROM n_customer WHERE CASE WHEN external_id::BIGINT % 3 = 0 THEN 'planet' ELSE 'document' END = 'document'")
def join_registry_enum(g: Lens) -> DataFrame:
    kinds = g.nodes("customer").select("node_id", F.when(F.col("external_id").cast("long") % 3 == 0, "planet").otherwise("document").alias("node_type"))
    return kinds.join(F.broadcast(extract.seed_node_types(g.spark)), "node_type", "left_semi").select("node_id")


@query("SELECT source_id, target_id, relationship, split_part(source_id, ':', 1) AS source_type, split_part(target_id, ':', 1) AS target_type FROM (SELECT * FROM e_member_of UNION ALL SELECT * FROM e_authored UNION ALL SELECT * FROM e_part_of) WHERE relationship <> 'PART_OF'")
def validate_endpoints(g: Lens) -> DataFrame:
    return extract.validate_endpoints(g.edges("MEMBER_OF", "AUTHORED", "PART_OF"), g.nodes("customer", "supplier", "nation", "region", "order"), F.broadcast(extract.seed_relationships(g.spark)))


def _rounded(v: Column) -> Column:
    return F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4)


@query("SELECT node_id, 64::INT AS dim, 1.0::DOUBLE AS norm FROM n_document")
def embed_batch(g: Lens) -> DataFrame:
    docs = g.nodes("document").select("node_id", text.node_text(F.col("name"), F.col("summary")).alias("body"))
    return extract.embed_batch(docs, "body").select("node_id", F.size("embedding").alias("dim"), _rounded(F.col("embedding")).alias("norm"))


@query("SELECT text AS body, count(*) AS n_rows, 1::BIGINT AS n_vectors FROM documents GROUP BY 1")
def embed_deterministic(g: Lens) -> DataFrame:
    """Equal texts have equal vectors."""
    rows = extract.embed_batch(g.table("documents").select(F.col("text").alias("body")), "body")
    return rows.groupBy("body").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.to_json(F.col("embedding"))).alias("n_vectors"))


@query("SELECT doc_id, length(text)::FLOAT AS first FROM documents")
def udf_provider_embed(g: Lens) -> DataFrame:
    rows = extract.embed_batch(g.table("documents").select("doc_id", "text"), "text", lambda texts: [[float(len(t)), 1.0] for t in texts])
    return rows.select("doc_id", F.element_at("embedding", 1).alias("first"))


@query("SELECT p_name AS dedup_key, 'unsure' AS verdict, 0.0::DOUBLE AS judged FROM part")
def udf_judge(g: Lens) -> DataFrame:
    """Without a judge all abstain."""
    return extract.judge_pairs(g.table("part").select(F.col("p_name").alias("dedup_key")))


_RAW = "'document' AS source_type, source AS source_system, doc_id::VARCHAR AS external_id"


def _document_image(g: Lens) -> DataFrame:
    """Documents of even ids, as landed before."""
    d = g.table("documents").where("doc_id % 2 = 0")
    none = F.lit(None).cast("timestamp")
    return d.select(F.col("source").alias("source_system"), F.lit("document").alias("source_type"), F.col("doc_id").cast("string").alias("external_id"), F.lit("old").alias("content"), F.lit("2020-01-01").cast("timestamp").alias("source_created_at"), none.alias("source_updated_at"), text.content_hash(F.lit("old")).alias("content_hash"), F.lit("seen").alias("extracted_hash"))


@query("SELECT source AS source_system, doc_id::VARCHAR AS external_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'old' END AS content, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2024-01-01' END AS source_created_at, CASE WHEN doc_id % 2 = 0 THEN 'seen' END AS extracted_hash, CASE WHEN doc_id % 3 <> 0 THEN sha256('old') WHEN coalesce(text, '') <> '' THEN sha256(text) END AS content_hash FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def upsert_documents(g: Lens) -> DataFrame:
    """Documents of ids divisible by three arrive twice; the later arrival counts."""
    d = g.table("documents").where("doc_id % 3 = 0").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    inc = d.select(F.col("source").alias("source_system"), F.lit("document").alias("source_type"), F.col("doc_id").cast("string").alias("external_id"), F.when(F.col("seq") == 2, F.col("text")).otherwise("first").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("source_created_at"), F.lit(None).cast("timestamp").alias("source_updated_at"), "seq")
    return resolve.upsert_documents(_document_image(g), inc).select("source_system", "external_id", "content", "source_created_at", "extracted_hash", "content_hash")


def _seen_nodes(g: Lens) -> DataFrame:
    e = g.table("events")
    return e.select(F.lit("customer").alias("node_type"), F.lit("crm").alias("source_system"), F.col("user_id").cast("string").alias("external_id"), F.concat(F.lit("event "), "event_id").alias("name"), F.lit(None).cast("string").alias("summary"), F.from_json("props", _BAG).alias("properties"), F.lit(0.9).alias("confidence"), F.col("event_id").alias("seq"))


@query(", u AS (SELECT user_id, 'event ' || max(event_id) AS name, arg_max(json_extract_string(props, '$.k'), event_id) AS k FROM events GROUP BY 1) SELECT coalesce(external_id, user_id::VARCHAR) AS external_id, coalesce(u.name, n.name) AS name, k, CASE WHEN n.node_id IS NULL THEN 'created' WHEN user_id IS NULL THEN 'kept' ELSE 'updated' END AS change FROM n_customer n FULL JOIN u ON n.external_id = u.user_id::VARCHAR")
def resolve_sourced(g: Lens) -> DataFrame:
    out = resolve.upsert_sourced(g.nodes("customer"), _seen_nodes(g))
    return out.select("external_id", "name", F.try_element_at("properties", F.lit("k")).alias("k"), "change")


@query("SELECT user_id::VARCHAR || '/' || event_type AS k, 'customer:' || user_id AS node_id, 'type:' || event_type AS document_id, arg_min(props, event_id) AS context FROM events GROUP BY user_id, event_type")
def record_mentions(g: Lens) -> DataFrame:
    e = g.table("events")
    seen = e.select(F.concat(F.lit("customer:"), "user_id").alias("node_id"), F.concat(F.lit("type:"), "event_type").alias("document_id"), F.col("props").alias("context"), F.col("event_id").alias("seq"))
    none = seen.limit(0).select("node_id", "document_id", "context")
    out = resolve.record_mentions(none, seen)
    return out.select(F.concat_ws("/", F.substring("node_id", 10, 30), F.substring("document_id", 6, 30)).alias("k"), "node_id", "document_id", "context")


@query(_PART_TRI + """, known AS (SELECT name FROM dn WHERE length(name) % 2 = 0), fresh AS (SELECT p_name AS name, min(p_partkey) AS seq FROM part WHERE length(p_name) % 2 = 1 GROUP BY 1),
 ways AS (SELECT a AS name, b AS other, similarity FROM np WHERE similarity >= 0.45 UNION ALL SELECT b, a, similarity FROM np WHERE similarity >= 0.45),
 matched AS (SELECT f.name, arg_min('known:' || k.name, (-similarity, 'known:' || k.name)) AS node_id FROM fresh f JOIN ways USING (name) JOIN known k ON k.name = other GROUP BY 1),
 rest AS (SELECT name, seq FROM fresh ANTI JOIN matched USING (name)),
 near AS (SELECT name, other FROM ways WHERE name IN (SELECT name FROM rest) AND other IN (SELECT name FROM rest)),
 heads AS (SELECT name, arg_min(other, (seq, other)) AS head FROM (SELECT r.name, r.other, s.seq FROM (WITH RECURSIVE reach AS (SELECT name, name AS other FROM rest UNION SELECT reach.name, near.other FROM reach JOIN near ON near.name = reach.other) SELECT * FROM reach) r JOIN rest s ON s.name = r.other) GROUP BY 1)
 SELECT name, node_id, 'enriched' AS change FROM matched UNION ALL SELECT name, sha256('part|' || head), CASE WHEN name = head THEN 'created' ELSE 'merged' END FROM heads""")
def resolve_derived(g: Lens) -> DataFrame:
    names = g.table("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("seq"))
    known = names.where("length(name) % 2 = 0").select(F.concat(F.lit("known:"), "name").alias("node_id"), F.lit("part").alias("node_type"), "name", F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("string").alias("canonical_node_id"))
    fresh = names.where("length(name) % 2 = 1").select(F.lit("part").alias("node_type"), "name", "seq")
    return resolve.resolve_derived(known, fresh, 0.45).select("name", "node_id", "change")


@query(_PART_TRI + """, known AS (SELECT name FROM dn WHERE length(name) % 7 = 0), fresh AS (SELECT p_name AS name, min(p_partkey) AS seq FROM part WHERE length(p_name) % 7 <> 0 GROUP BY 1),
 ways AS (SELECT a AS name, b AS other, similarity FROM np WHERE similarity >= 0.45 UNION ALL SELECT b, a, similarity FROM np WHERE similarity >= 0.45),
 old AS (SELECT f.name, 'known:' || k.name AS node_id, similarity FROM fresh f JOIN ways USING (name) JOIN known k ON k.name = other),
 turn AS (SELECT name, seq, row_number() OVER (ORDER BY seq) AS k, name IN (SELECT name FROM old) AS met, coalesce((SELECT list(w.other) FROM ways w JOIN fresh o ON o.name = w.other WHERE w.name = f.name AND o.seq < f.seq), []) AS before FROM fresh f),
 walk AS (WITH RECURSIVE go(k, heads) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT t.k, CASE WHEN t.met OR list_has_any(go.heads, t.before) THEN go.heads ELSE list_append(go.heads, t.name) END FROM go JOIN turn t ON t.k = go.k + 1) SELECT heads FROM go ORDER BY k DESC LIMIT 1),
 head AS (SELECT unnest(heads) AS name FROM walk),
 best AS (SELECT name, arg_min({'to': node_id, 'change': change}, (-round(similarity, 12), node_id)) AS b FROM (
  SELECT name, node_id, 'enriched' AS change, similarity FROM old UNION ALL
  SELECT w.name, sha256('part|' || w.other), 'merged', similarity FROM ways w JOIN fresh f ON f.name = w.name JOIN head h ON h.name = w.other JOIN fresh o ON o.name = w.other AND o.seq < f.seq WHERE w.name NOT IN (SELECT name FROM head)) GROUP BY 1)
 SELECT name, b.to AS node_id, b.change AS change FROM best UNION ALL SELECT name, sha256('part|' || name), 'created' FROM head""")
def resolve_sequential(g: Lens) -> DataFrame:
    """Part names as they come by key, each to the best node of its turn."""
    names = g.table("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("seq"))
    none = F.lit(None).cast("string")
    known = names.where("length(name) % 7 = 0").select(F.concat(F.lit("known:"), "name").alias("node_id"), F.lit("part").alias("node_type"), "name", none.alias("external_id"), none.alias("canonical_node_id"))
    fresh = names.where("length(name) % 7 <> 0").select(F.lit("part").alias("node_type"), "name", "seq")
    return resolve.resolve_derived(known, fresh, 0.45, strategy="sequential").select("name", "node_id", "change")


@query(""", nm AS (SELECT 'vec ' || vec_id AS name, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
 gr AS (SELECT name, vec_id, v, list_distinct(flatten(list_transform(regexp_split_to_array(name, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3))))) AS g FROM nm),
 cand AS (SELECT x.name, 'vec:' || y.vec_id AS node_id, round(1 - list_cosine_similarity(x.v, y.v), 12) AS d, round(len(list_intersect(x.g, y.g))::DOUBLE / len(list_distinct(list_concat(x.g, y.g))), 12) AS s FROM gr x JOIN gr y ON x.vec_id % 2 = 1 AND y.vec_id % 2 = 0)
 SELECT name, arg_min(node_id, (d, -s, node_id)) AS node_id FROM cand WHERE s >= 0.55 OR d <= 0.6 GROUP BY 1""")
def resolve_derived_vectors(g: Lens) -> DataFrame:
    """Vectors of odd ids against those of even ids: by name or by vector, the nearest vector first."""
    v = g.vectors.select("node_id", F.lit("vec").alias("node_type"), "name", "embedding", (F.split_part("node_id", F.lit(":"), F.lit(2)).cast("long")).alias("seq"))
    none = F.lit(None).cast("string")
    known = v.where("seq % 2 = 0").select("node_id", "node_type", "name", "embedding", none.alias("external_id"), none.alias("canonical_node_id"))
    return resolve.match_derived(known, v.where("seq % 2 = 1"), 0.55, 0.6).select("name", F.col("matched_id").alias("node_id"))


def _file_nodes(g: Lens) -> DataFrame:
    """Every third link target exists as a file of the same slug."""
    links = g.edges("LINKS").select("target_id").distinct().withColumn("name", F.regexp_replace("target_id", "^concept:", ""))
    return links.where("length(name) % 3 = 0").select(F.concat(F.lit("file:"), "name").alias("node_id"), F.concat("name", F.lit(".md")).alias("name"))


_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '\\.md$', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_MAPPED = f""", c AS (SELECT DISTINCT target_id AS old_id, substr(target_id, 9) AS name FROM e_links), f AS (SELECT {_SLUG.format(c="name || '.md'")} AS slug, min('file:' || name) AS new_id FROM c WHERE length(name) % 3 = 0 GROUP BY 1),
 mp AS (SELECT old_id, new_id FROM c JOIN f ON f.slug = {_SLUG.format(c="name")} WHERE f.slug <> '')
"""


def _mapping(g: Lens) -> DataFrame:
    concepts = g.edges("LINKS").select(F.col("target_id").alias("node_id")).distinct().withColumn("name", F.regexp_replace("node_id", "^concept:", ""))
    return resolve.wikilink_mapping(_file_nodes(g), concepts)


@query(_MAPPED + "SELECT * FROM mp")
def join_wikilink_slug(g: Lens) -> DataFrame:
    return _mapping(g)


_REDIRECTED = _MAPPED + """SELECT source_id, target_id FROM (SELECT DISTINCT source_id, coalesce(new_id, target_id) AS target_id FROM e_links LEFT JOIN mp ON old_id = target_id)"""


@query(_REDIRECTED)
def reconcile_wikilinks(g: Lens) -> DataFrame:
    return resolve.redirect_edges(g.edges("LINKS"), _mapping(g)).select("source_id", "target_id")


@query(_REDIRECTED + " WHERE starts_with(target_id, 'file:')")
def set_redirect_insert(g: Lens) -> DataFrame:
    return resolve.redirect_edges(g.edges("LINKS"), _mapping(g)).where("target_id like 'file:%'").select("source_id", "target_id")


@query(", cu AS (SELECT source_system, resource_key, arg_max(cursor, (started_at, run_id))::BIGINT AS c FROM runs WHERE status = 'completed' AND run_id % 2 = 0 GROUP BY 1, 2) SELECT 'event:' || event_id AS document_id FROM event_docs LEFT JOIN cu USING (source_system, resource_key) WHERE c IS NULL OR event_id >= c")
def incremental_docs(g: Lens) -> DataFrame:
    items = g.event_docs.select("document_id", "source_system", "resource_key", F.col("external_id").cast("long").alias("item_cursor"))
    return resolve.incremental(items, g.runs.where("run_id % 2 = 0")).select("document_id")


@query("SELECT 'page:' || page_id AS source_id, count(DISTINCT href) AS n_edges FROM hrefs GROUP BY 1")
def ingest_pipeline(g: Lens) -> DataFrame:
    """Pages landed, extracted, resolved and folded into edges."""
    docs = _href_docs(g).withColumn("content_hash", text.content_hash(F.col("content"))).withColumn("extracted_hash", F.lit(None).cast("string"))
    got = extract.extract_rules(blocks.changed_documents(docs), _hrefs())
    found = got.select("document_id", F.inline("edges"))
    ids = got.select("document_id", F.inline("nodes")).select("document_id", "temp_id", F.when(F.col("temp_id") == "doc", F.col("document_id")).otherwise(F.concat(F.lit("concept:"), "name")).alias("node_id"))
    seen = resolve.resolve_edges(found, ids).withColumns({"properties": _no_bag(), "evidence_document_id": F.col("document_id"), "seq": F.col("document_id")})
    return resolve.fold_edges(seen).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_edges"))


def _unmapped(g: Lens) -> DataFrame:
    e = g.table("events")
    return e.select(F.lit("node").alias("kind"), F.concat(F.lit("kind_"), "event_type").alias("name"), F.col("props").alias("example"), F.col("event_id").alias("document_id"))


@query("SELECT 'schema_node_type' AS kind, 'kind_' || event_type AS dedup_key, arg_min(props, event_id) AS example FROM events GROUP BY event_type")
def file_unmapped(g: Lens) -> DataFrame:
    return extract.file_unmapped(_unmapped(g)).select("kind", "dedup_key", F.try_element_at("payload", F.lit("example")).alias("example"))


@query("SELECT 'schema_node_type' AS kind, 'kind_' || event_type AS dedup_key, 0.5::DOUBLE AS confidence FROM events GROUP BY event_type")
def scan_schema_drift(g: Lens) -> DataFrame:
    return extract.file_unmapped(_unmapped(g)).select("kind", "dedup_key", "confidence")


@query(", r AS (SELECT event_type, props, event_id FROM events ORDER BY ts DESC, event_id LIMIT 50) SELECT 'kind_' || event_type AS dedup_key, arg_min(props, event_id) AS example FROM r GROUP BY event_type")
def sample_missing_types(g: Lens) -> DataFrame:
    """The newest documents go to an extractor that reports their source as a type that it lacks."""
    recent = g.event_docs.orderBy(F.col("created_at").desc(), F.col("external_id").cast("long")).limit(50)
    shown = recent.select("document_id", F.concat(F.lit("title: "), F.coalesce("title", "source_system"), F.lit("\n---\n"), text.clip_text(F.col("content"), 12_000)).alias("rendered"))

    def extractor(document_id: str, rendered: str) -> dict:
        title, body = rendered.split("\n---\n", 1)
        return {"unmapped": [{"kind": "node", "name": f"kind_{title.removeprefix('title: ')}", "example": body}]}

    found = extract.extract_model(shown, extractor).select(F.split_part("document_id", F.lit(":"), F.lit(2)).cast("long").alias("document_id"), F.inline("unmapped"))
    return extract.file_unmapped(found).select("dedup_key", F.try_element_at("payload", F.lit("example")).alias("example"))


def _stamped(g: Lens) -> DataFrame:
    k = F.col("external_id").cast("long")
    model = F.when(k % 3 == 0, "m2").when(k % 3 == 1, "m1")
    return g.nodes("supplier").withColumn("properties", F.when(model.isNotNull(), scores.stamp(F.col("properties"), "embedding_model", model)).otherwise(F.col("properties")))


@query("SELECT node_id FROM n_supplier WHERE external_id::BIGINT % 3 <> 0")
def plan_backfill(g: Lens) -> DataFrame:
    return extract.plan_backfill(_stamped(g), "m2").select("node_id")


@query("SELECT node_id, 'm2' AS model, 64::INT AS dim FROM n_supplier WHERE external_id::BIGINT % 3 <> 0")
def run_backfill(g: Lens) -> DataFrame:
    return extract.run_backfill(_stamped(g), "m2").select("node_id", F.try_element_at("properties", F.lit("embedding_model")).alias("model"), F.size("embedding").alias("dim"))


def _terms(g: Lens) -> DataFrame:
    return g.table("part").select(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "_")).alias("node_type")).distinct()


_BRANDS = "SELECT DISTINCT lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')) AS node_type FROM part"
_SEEDED = " UNION ".join(f"SELECT '{t}'" for t in schema.NODE_TYPES)


@query(f"{_BRANDS} UNION {_SEEDED}")
def seed_ontology(g: Lens) -> DataFrame:
    return extract.seed_ontology(_terms(g), extract.seed_node_types(g.spark), "node_type")


@query(_BRANDS)
def live_registry(g: Lens) -> DataFrame:
    return extract.live_registry(_terms(g), extract.seed_node_types(g.spark))


# --- proposals


def _queue(g: Lens) -> DataFrame:
    q = blocks.proposals(g)
    return q.select("proposal_id", "kind", F.create_map(F.lit("node_id"), "node_id").alias("payload"), "confidence", "agent", _no_bag().alias("evidence"), "dedup_key", "status", "created_at", "decided_at", "applied_at", F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("string").alias("error"))


@query(_P + ", f AS (SELECT 'stale_flag:' || c_custkey AS dedup_key, round((c_custkey % 10) / 10.0, 2) AS confidence FROM customer) SELECT status, count(*) AS n FROM (SELECT status FROM proposals UNION ALL SELECT CASE WHEN confidence >= 0.9 THEN 'auto_applied' ELSE 'pending' END FROM f WHERE dedup_key NOT IN (SELECT dedup_key FROM proposals)) GROUP BY 1")
def submit_proposals(g: Lens) -> DataFrame:
    found = g.table("customer").select(F.lit("stale_flag").alias("kind"), F.create_map(F.lit("node_id"), F.concat(F.lit("customer:"), "c_custkey")).alias("payload"), F.round(F.col("c_custkey") % 10 / 10, 2).alias("confidence"), F.lit("staleness").alias("agent"), _no_bag().alias("evidence"), F.concat(F.lit("stale_flag:"), "c_custkey").alias("dedup_key"))
    return proposals.submit(_queue(g), found, g.now, 0.9).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(_P + "SELECT proposal_id, CASE WHEN status = 'pending' AND confidence >= 0.5 THEN 'approved' ELSE status END AS status FROM proposals")
def decide_proposals(g: Lens) -> DataFrame:
    q = _queue(g)
    return proposals.decide(q, proposals.approve_over(q, 0.5), g.now)[0].select("proposal_id", "status")


@query(_P + "SELECT proposal_id, CASE WHEN kind = 'edge_add' AND status = 'approved' THEN 'failed' ELSE status END AS status, CASE WHEN kind = 'edge_add' AND status = 'approved' THEN 'edge exists' END AS error FROM proposals")
def failed_apply_log(g: Lens) -> DataFrame:
    q = _queue(g)
    bad = q.where("kind = 'edge_add' and status = 'approved'").select("proposal_id", F.lit("edge exists").alias("error"))
    return proposals.failed_log(q, bad).select("proposal_id", "status", "error")


@query(_P + "SELECT proposal_id, kind, status, confidence, CASE kind WHEN 'stale_flag' THEN 'flag stale: ' || node_id WHEN 'entity_merge' THEN NULL ELSE '{\"node_id\":\"' || node_id || '\"}' END AS line FROM proposals WHERE status = 'pending' ORDER BY confidence DESC, created_at, proposal_id LIMIT 50")
def queue_report(g: Lens) -> DataFrame:
    return proposals.queue_report(_queue(g), "pending", 50, summarize_proposal(F.col("kind"), F.col("payload")))


def _merge_input(g: Lens) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Suppliers 2k and 2k + 1 are merged, into the even one."""
    nodes = g.nodes("supplier")
    edges = g.edges("DEPENDS_ON").withColumn("properties", F.create_map(F.lit("via"), "target_id"))
    s = g.table("supplier")
    mentions = s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("node_id"), F.concat(F.lit("d:"), F.floor(F.col("s_suppkey") / 2)).alias("document_id"), F.concat(F.lit("m "), "s_suppkey").alias("context"))
    merges = s.where("s_suppkey % 2 = 1").select(F.concat(F.lit("p:"), "s_suppkey").alias("proposal_id"), F.concat(F.lit("supplier:"), F.col("s_suppkey") - 1).alias("winner_id"), F.concat(F.lit("supplier:"), "s_suppkey").alias("loser_id"), F.lit(0.9).alias("confidence"))
    return nodes, edges, mentions, merges


_MERGED = """, k AS (SELECT s_suppkey, s_suppkey % 2 = 1 AND s_suppkey - 1 IN (SELECT s_suppkey FROM supplier) AS loser FROM supplier),
 me AS (SELECT source_id, CASE WHEN loser THEN 'supplier:' || (s_suppkey - 1) ELSE target_id END AS target_id, weight, confidence, loser FROM e_depends_on JOIN k ON target_id = 'supplier:' || s_suppkey)
"""


@query(_MERGED + "SELECT source_id, target_id, sum(weight) AS weight, max(confidence) AS confidence, CASE WHEN bool_or(NOT loser) THEN target_id ELSE 'supplier:' || (split_part(target_id, ':', 2)::BIGINT + 1) END AS via FROM me GROUP BY 1, 2")
def apply_entity_merge(g: Lens) -> DataFrame:
    m = proposals.apply_entity_merge(*_merge_input(g))
    return m.edges.select("source_id", "target_id", "weight", "confidence", F.try_element_at("properties", F.lit("via")).alias("via"))


@query(""", k AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey - s_suppkey % 4 IN (SELECT s_suppkey FROM supplier) THEN s_suppkey - s_suppkey % 4 WHEN s_suppkey % 4 = 3 THEN s_suppkey - 1 ELSE s_suppkey END AS root FROM supplier)
 SELECT source_id, 'supplier:' || root AS target_id, sum(weight) AS weight, max(confidence) AS confidence FROM e_depends_on JOIN k ON target_id = 'supplier:' || s GROUP BY 1, 2""")
def apply_entity_merge_groups(g: Lens) -> DataFrame:
    """Suppliers by fours: 1 and 2 go into 0, after 3 went into 2; 3 into 1 comes too late."""
    nodes, edges, mentions, _ = _merge_input(g)
    number = lambda k: F.concat(F.lit("supplier:"), F.col("first") + k)
    fours = g.table("supplier").select((F.col("s_suppkey") - F.col("s_suppkey") % 4).alias("first")).distinct()
    asked = F.explode(F.array(*(F.struct(F.concat(F.lit(f"p{w}{x}:"), "first").alias("proposal_id"), number(w).alias("winner_id"), number(x).alias("loser_id"), F.lit(c).alias("confidence")) for w, x, c in ((0, 1, 0.9), (2, 3, 0.85), (0, 2, 0.8), (1, 3, 0.7)))))
    return proposals.apply_entity_merge(nodes, edges, mentions, fours.select(asked.alias("m")).select("m.*")).edges.select("source_id", "target_id", "weight", "confidence")


@query("SELECT source_id, target_id, weight, confidence FROM e_depends_on")
def rollback_entity_merge(g: Lens) -> DataFrame:
    nodes, edges, mentions, merges = _merge_input(g)
    m = proposals.apply_entity_merge(nodes, written(edges, "edges"), mentions, merges)
    return proposals.rollback_entity_merge(m, m.nodes, m.edges, m.mentions)[1].select("source_id", "target_id", "weight", "confidence")


@query("SELECT 'customer:' || c_custkey AS node_id, CASE WHEN c_acctbal < 0 OR c_custkey % 4 = 0 THEN 'true' ELSE 'false' END AS stale, CASE WHEN c_acctbal >= 0 AND c_custkey % 4 = 0 THEN '2024-01-02' ELSE strftime(DATE '2023-01-01' + (c_custkey % 300)::INT, '%Y-%m-%d') END AS since FROM customer")
def apply_stale_flag(g: Lens) -> DataFrame:
    nodes = g.nodes("customer")
    flags = nodes.where("cast(external_id as bigint) % 4 = 0").select("node_id", F.lit("2024-01-02").alias("last_seen"))
    return proposals.apply_stale_flag(nodes, flags)[0].select("node_id", F.try_element_at("properties", F.lit("stale")).alias("stale"), F.try_element_at("properties", F.lit("stale_since")).alias("since"))


@query("SELECT 'part:' || a.first_key AS node_id, list_aggregate(list_sort(list(DISTINCT x)), 'string_agg', ' | ') AS disputed FROM (SELECT a.first_key, unnest([a.p_brand, b.p_brand]) AS x FROM parts a JOIN part b ON b.p_partkey = a.first_key WHERE a.first_key <> a.p_partkey AND a.p_brand <> b.p_brand) a GROUP BY 1")
def apply_fact_conflict(g: Lens) -> DataFrame:
    found = scans.scan_contradictions(g.parts, None).select(*(F.try_element_at("payload", F.lit(k)).alias(k) for k in ("node_id", "key", "value", "alias_value")))
    out, _ = proposals.apply_fact_conflict(g.parts, found)
    return out.select("node_id", F.try_element_at("properties", F.lit("disputed.brand")).alias("disputed")).where("disputed is not null")


def _adds(g: Lens) -> DataFrame:
    return g.table("customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("source_id"), F.concat(F.lit("nation:"), F.col("c_custkey") % 30).alias("target_id"), F.lit("MEMBER_OF").alias("relationship"), F.lit(0.8).alias("confidence"))


@query("SELECT 'customer:' || c_custkey AS source_id, 'nation:' || (c_custkey % 30) AS target_id, CASE WHEN c_custkey % 30 >= 25 THEN 'no such node' WHEN c_nationkey = c_custkey % 30 THEN 'edge exists' END AS error FROM customer")
def apply_edge_add(g: Lens) -> DataFrame:
    """Added edges and the errors of those that can't be."""
    edges = g.edges("MEMBER_OF").where("source_id like 'customer:%'")
    after, errors = proposals.apply_edge_add(edges, g.nodes("customer", "nation"), _adds(g), extract.seed_relationships(g.spark))
    made = after.join(edges, ["source_id", "target_id", "relationship"], "left_anti").select("source_id", "target_id", F.lit(None).cast("string").alias("error"))
    return made.unionByName(errors.select("source_id", "target_id", "error"))


@query("SELECT node_id FROM (SELECT * FROM n_vec UNION ALL SELECT * FROM n_supplier) WHERE NOT (node_type LIKE 'vec%' AND external_id::BIGINT % 2 = 0)")
def apply_node_removal(g: Lens) -> DataFrame:
    nodes = g.nodes("vec", "supplier")
    asked = nodes.where("cast(external_id as bigint) % 2 = 0").select("node_id")
    return proposals.apply_node_removal(nodes, g.edges("MEMBER_OF"), g.mentions, asked)[0].select("node_id")


@query("SELECT source_id, target_id FROM e_references WHERE NOT confidence < 0.93")
def apply_edge_removal(g: Lens) -> DataFrame:
    edges = g.edges("REFERENCES")
    weak = scans.scan_weak_edges(edges, 0.93, None).select(*(F.try_element_at("payload", F.lit(k)).alias(k) for k in resolve.EDGE_KEY))
    return proposals.apply_edge_removal(edges, weak)[0].select("source_id", "target_id")


@query(f"SELECT 'made_' || event_type AS node_type FROM events GROUP BY 1 UNION {_SEEDED}")
def apply_schema_type(g: Lens) -> DataFrame:
    names = g.table("events").select(F.concat(F.lit("made_"), "event_type").alias("name")).unionByName(g.table("events").select(F.concat(F.lit("Bad "), "event_type").alias("name")))
    return proposals.apply_schema_type(extract.seed_node_types(g.spark), names, "node_type")[0]
