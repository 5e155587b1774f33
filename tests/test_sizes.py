"""What only larger tables hold: queries on small tables made for it, against their SQL to the last bit."""

import math
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from graphloom.operators import graphs, reads, resolve, search
from graphloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(spark, folder, name, **own):
    """The query's rows and its SQL's, sorted, with ``own`` tables in place of the smallest ones."""
    duck = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if t in own:
            pq.write_table(own[t], path)
        else:
            os.symlink(f"{SF}/{t}.parquet", path)
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(folder))
    asked = ", ".join(f'"{c}"' for c in df.columns)
    theirs = duck.execute(f"SELECT {asked} FROM ({ORACLES[name]})").fetchall()
    return sorted(repr(tuple(r)) for r in df.collect()), sorted(map(repr, theirs))


def vectors(*rows):
    return pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})


def test_signs_of_rounded_zeros(spark, tmp_path):
    ours, theirs = same_rows(spark, tmp_path, "fn_l2_normalize", embeddings=vectors((1, [-1e-7, 1.0, 1e-7]), (2, [-0.0, 0.5, -0.5])))
    assert "-0.0" in theirs[0] and ours == theirs


def pages(*rows):
    return pa.table({"page_id": pa.array([i for i, _ in rows], pa.int64()), "url": [f"https://a.example/{i}" for i, _ in rows], "html": [h for _, h in rows]})


ENTITIES = pages((1, "<p>a &amp b &amp; c</p>"), (2, "x &lt y &amp;lt; &copy z &quot;"), (3, "cut in an entity &am"), (4, "cut &#39"), (5, "<b>&&amp</b>&nbsp;&apos;"), (6, None))


def test_open_entities_stay_in_pages(spark, tmp_path):
    ours, theirs = same_rows(spark, tmp_path, "fn_strip_html", pages=ENTITIES)
    assert "a &amp b & c" in theirs[0] and ours == theirs


def test_open_entities_stay_in_wiki_pages(spark, tmp_path):
    ours, theirs = same_rows(spark, tmp_path, "src_confluence_page", pages=ENTITIES.slice(0, 5))
    assert len(ours) == 5 and ours == theirs


def edge_of(distance):
    """Vectors of two numbers that lie a rounded distance apart, and a little over it or under."""
    at = lambda d: [1 - d, math.sqrt(1 - (1 - d) ** 2)]
    return vectors((2, [1.0, 0.0]), (4, at(distance + 3e-7)), (20, [0.0, -1.0]), (22, [math.sqrt(1 - (1 - distance - 8e-7) ** 2), distance + 8e-7 - 1]))


def test_pairs_at_the_edge_of_a_rounded_distance(spark, tmp_path):
    for name, distance, n in (("knn_join", 0.6, 1), ("self_vector_pairs_no_edge", 0.65, 1)):
        (folder := tmp_path / name).mkdir()
        ours, theirs = same_rows(spark, folder, name, embeddings=edge_of(distance))
        assert ours == theirs and sum("'vec:2', 'vec:4'" in r for r in theirs) == n


def test_links_at_the_edge_of_a_rounded_distance(spark, tmp_path):
    ours, theirs = same_rows(spark, tmp_path, "scan_link_prediction", embeddings=edge_of(0.65))
    assert ours == theirs and any("vec:2:vec:4" in r for r in theirs)


def hub(spark, starts=30, leaves=300):
    """Starts and leaves around one node, and a second ring behind each tenth leaf."""
    pairs = [(f"s{i:03}", "hub", "IN") for i in range(starts)] + [(f"l{i:03}", "hub", "IN") for i in range(leaves)] + [(f"r{i:03}", f"l{i:03}", "BY") for i in range(0, leaves, 10)]
    ids = sorted({n for a, b, _ in pairs for n in (a, b)})
    edges = spark.createDataFrame(pairs, "source_id string, target_id string, relationship string")
    nodes = spark.createDataFrame([(n, n.upper(), {"l": "leaf", "r": "rim"}.get(n[0], "other"), None) for n in ids], "node_id string, name string, node_type string, canonical_node_id string")
    return edges, nodes, nodes.where("node_id like 's%'").select(F.col("node_id").alias("start_id"))


def rows_written(monkeypatch, module):
    """A list that gets the number of rows of each table that the module writes."""
    counts, put = [], module.written

    def counted(df, name):
        out = put(df, name)
        counts.append(out.count())
        return out

    monkeypatch.setattr(module, "written", counted)
    return counts


def distances(pairs, start, depth):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found, front = {start: 0}, {start}
    for k in range(1, depth + 1):
        front = {n for m in front for n in near.get(m, ())} - set(found)
        found |= dict.fromkeys(front, k)
    return found


def test_starts_around_a_hub_walk_once(spark, monkeypatch):
    edges, nodes, starts = hub(spark)
    pairs = [(r["source_id"], r["target_id"]) for r in edges.collect()]
    want = sorted((r["start_id"], n, k) for r in starts.collect() for n, k in distances(pairs, r["start_id"], 3).items())
    counts = rows_written(monkeypatch, graphs)
    assert sorted(map(tuple, graphs.khop_nodes(edges, starts, 3).collect())) == want
    assert sum(counts) < 600  # one walk over the nodes and not one for each of 30 starts
    counts.clear()
    walked = graphs.first_arrivals(edges, nodes, starts, 3).collect()
    assert sorted((r["start_id"], r["node_id"], r["depth"]) for r in walked) == want and sum(counts) < 600
    assert all(r["names"] == [r["start_id"].upper(), "HUB", f"L{r['node_id'][1:]}", r["node_id"].upper()] for r in walked if r["node_id"][0] == "r")
    counts.clear()
    found = sorted((r["start_id"], r["node_id"], r["depth"]) for r in graphs.traverse_to_type(edges, nodes, starts, "other", 3, 4).collect())
    assert found == sorted((s, n, k) for s in {w[0] for w in want} for n, k in sorted(((n, k) for x, n, k in want if x == s and k and n[0] in "hs"), key=lambda x: x[::-1])[:4])
    assert sum(counts) < 700


def test_walks_end_when_enough_is_found(spark, monkeypatch):
    edges, nodes, starts = hub(spark)
    counts = rows_written(monkeypatch, graphs)
    assert {r["depth"] for r in graphs.first_arrivals(edges, nodes, starts, 3, enough=30).collect()} == {0, 1}
    assert sum(counts) < 150
    assert {r["depth"] for r in graphs.first_arrivals(edges, nodes, starts, 3, enough=31).collect()} == {0, 1, 2}


def test_subgraphs_around_a_hub_take_its_first_edges_only(spark, monkeypatch):
    edges, nodes, starts = hub(spark)
    ranked, met = reads.ranked, []
    monkeypatch.setattr(reads, "ranked", lambda df, per, *more: (met.append(df.count()), ranked(df, per, *more))[1])
    got = graphs.khop_subgraph(edges, nodes, starts, 2, 5).collect()
    rows = [tuple(r) for r in edges.select("source_id", "relationship", "target_id").collect()]
    for s in ("s000", "s017"):
        near = distances([(a, b) for a, _, b in rows], s, 1)
        own = sorted((min(near.get(a, 9), near.get(b, 9)), a, r, b) for a, r, b in rows if a in near or b in near)[:5]
        assert [(r["source"], r["relationship"], r["target"]) for r in sorted((r for r in got if r["start_id"] == s), key=lambda r: r["rank"])] == [tuple(x if i == 1 else f'"{x.upper()} ({"leaf" if x[0] == "l" else "other"})"' for i, x in enumerate(e)) for _, *e in own]
    assert max(met) < 1000  # 30 starts would meet 331 edges each


def test_queries_of_the_same_words_are_answered_once(spark, monkeypatch):
    nodes = [(f"n{i:03}", f"vec {i} label {i % 3}") for i in range(120)]
    asked = [(f"q{i:03}", ["label 1", "1 label label", "label 77", "label", "none label", "the"][i % 6]) for i in range(90)]
    want = []
    for q, query in asked:
        words = set(query.replace("the", "").split())
        scored = sorted((-round(sum(1 + math.log(name.split().count(w)) for w in sorted(words)) / (1 + math.log(5)), 6), name, n) for n, name in nodes if words and words <= set(name.split()))
        want += [(q, k, n, -s) for k, (s, _, n) in enumerate(scored[:7], 1)]
    ranked, met = reads.ranked, []
    monkeypatch.setattr(reads, "ranked", lambda df, per, *more: (met.append(df.count()), ranked(df, per, *more))[1])
    df = spark.createDataFrame(nodes, "node_id string, name string").withColumn("body", F.col("name"))
    got = search.keyword_batch(df, spark.createDataFrame(asked, "request_id string, query string"), 7).collect()
    assert sorted((r["request_id"], r["rank"], r["node_id"], r["score"]) for r in got) == want
    assert max(met) < 200  # each of the 90 queries alone would meet some 60 nodes


def test_vector_pairs_in_small_pieces_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PIECE", 16)
    monkeypatch.setattr(resolve, "TILE", 7)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 4)).round(1)
    v[140:] = v[0]
    df = spark.createDataFrame([(f"v{i:03}", "t", x.tolist()) for i, x in enumerate(v)], "node_id string, node_type string, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.round(1 - u @ u.T, 6) <= 0.3
    want = [(f"v{i:03}", f"v{j:03}") for i in range(150) for j in range(i + 1, 150) if near[i, j]]
    assert sorted((r["a"], r["b"]) for r in resolve.vector_pairs(df, 0.3, 30, places=6).collect()) == want


def test_names_with_a_near_vector_are_not_looked_up_by_name(spark, monkeypatch):
    known = spark.createDataFrame([(f"k{i}", "t", f"thing {i}", [1.0, i / 100], None, None) for i in range(9)], "node_id string, node_type string, name string, embedding array<double>, external_id string, canonical_node_id string")
    new = spark.createDataFrame([("t", "thing 10", [1.0, 0.031], 1), ("t", "thing 80", [-1.0, 0.0], 2), ("t", "thing 4", None, 3), ("t", "other", [0.0, -1.0], 4)], "node_type string, name string, embedding array<double>, seq long")
    looked_up, pairs = [], resolve.name_pairs
    monkeypatch.setattr(resolve, "name_pairs", lambda names, *more: (looked_up.extend(r["name"] for r in names.collect()), pairs(names, *more))[1])
    got = {r["name"]: r["matched_id"] for r in resolve.match_derived(known, new, 0.5, 0.1).collect()}
    # opposite vectors: those that lean over least are the nearest to it by name
    assert got == {"thing 10": "k3", "thing 80": "k8", "thing 4": "k4"}
    assert sorted(looked_up) == ["other", "thing 4", "thing 80"]


def test_ranks_over_many_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(graphs, "RANGE", 20)
    monkeypatch.setattr(graphs, "EDGES", 50)
    rng = np.random.default_rng(5)
    n, pairs = 90, [(int(a), int(b)) for a, b in zip(rng.integers(0, 60, 400), (rng.random(400) ** 3 * 90).astype(int))]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(n)], "node_id string")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs] + [("n1", "unknown"), ("unknown", "n2")], "source_id string, target_id string")
    out, rank = np.bincount([a for a, _ in pairs], minlength=n), np.full(n, 1 / n)
    for _ in range(7):
        got = np.zeros(n)
        for a, b in pairs:
            got[b] += rank[a] / out[a]
        rank = 0.15 / n + 0.85 * (got + rank[out == 0].sum() / n)
    found = {r["node_id"]: r["rank"] for r in graphs.pagerank(nodes, edges, iterations=7, cut_every=3).collect()}
    assert found.keys() == {f"n{i}" for i in range(n)} and max(abs(found[f"n{i}"] - rank[i] / rank.max()) for i in range(n)) < 6e-5
