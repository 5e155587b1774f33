"""Expectations on small literal tables, and properties: rollback undoes, a second scan finds nothing new."""

import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import scores, text
from graphloom.operators import extract, graphs, proposals, reads, resolve, scans, search, visibility
from graphloom.sources import dumps, landed
from graphloom.streaming import replay


def nodes_of(spark, *rows):
    full = [{"summary": None, "properties": {}, "source_system": None, "external_id": None, "canonical_node_id": None, "confidence": 1.0, "created_at": None} | r for r in rows]
    names = [c.split()[0] for c in schema.NODES.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema.NODES)


def one(df):
    return df.first()[0]


def test_text(spark):
    d = spark.range(1)
    assert round(one(d.select(text.trigram_similarity(F.lit("erin"), F.lit("erink")))), 2) == 0.57
    assert one(d.select(text.trigram_similarity(F.lit(""), F.lit("")))) == 0.0
    assert one(d.select(text.slugify(F.lit("  My Note.MD ")))) == "my-note"
    assert one(d.select(text.wikilinks(F.lit("[[b|x]] [[a#t]] [[b]] [[ ]]")))) == ["b", "a"]
    assert one(d.select(text.strip_html(F.lit("<p>a&amp;lt; b</p><br/>c <script>x</script>")))) == "a&lt; b\nc x"
    assert one(d.select(text.clip_text(F.lit("aaaaaaaaaaaaaaa\nbbbbbbbbbbbbbb"), 26))) == "aaaaaaaaaaaaaaa\n[cut]"
    assert one(d.select(text.render_path(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.array(F.lit(">R"), F.lit("<S"))))) == "A -[R]-> B <-[S]- C"


def test_scores(spark):
    d = spark.range(1)
    f = F.lit
    assert one(d.select(scores.blend_confidence(f(0.5), f(0.1)))) == 0.74
    assert one(d.select(scores.blend_confidence(f(0.5), f(None).cast("double")))) == 0.5
    assert one(d.select(scores.judge_confidence(f(1.0), f("different"), f(0.6)))) == 0.4
    assert one(d.select(scores.judge_confidence(f(0.5), f("same"), f(0.97)))) == 0.97
    assert one(d.select(scores.stale_confidence(f(400), 180))) > 0.5
    pairs = F.array(*(F.struct(f(k).alias("key"), f(v).alias("value")) for k, v in (("a", "1"), ("b", "2"), ("a", "3"))))
    assert one(d.select(scores.kv_to_map(pairs))) == {"a": "3", "b": "2"}
    assert one(d.select(scores.epoch_ts(f("x")))) is None


def test_english_stems(spark):
    # words and stems as the stemmer's authors publish them
    pairs = "consigned consign consistency consist consolatory consolatori conspirators conspir constancy constanc knackeries knackeri knitted knit generically generic skies sky ties tie hopping hop hoping hope national nation happy happi news news exceed exceed".split()
    words, want = pairs[::2], pairs[1::2]
    d = spark.createDataFrame([(1, words), (2, []), (3, words[:2])], "i int, w array<string>")
    from graphloom.functions import stems

    got = {r["i"]: r["s"] for r in d.select("i", stems.stemmed(F.col("w")).alias("s")).collect()}
    assert got == {1: want, 2: [], 3: want[:2]}
    n = nodes_of(spark, {"node_id": "1", "node_type": "t", "name": "Deployed the services"}, {"node_id": "2", "node_type": "t", "name": "servants"})
    assert [r["node_id"] for r in search.keyword_search(n, "deploying service", 5).collect()] == ["1"]


def test_pagerank_of_the_whole_graph(spark):
    from graphloom.lens import Lens
    from graphloom.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    g = Lens(spark, sf)
    ids = {r[0] for r in g.nodes().select("node_id").collect()}
    ends = [tuple(r) for r in g.edges().select("source_id", "target_id").collect() if r[0] in ids and r[1] in ids]
    out = {}
    for a, _ in ends:
        out[a] = out.get(a, 0) + 1
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(30):
        base = (0.15 + 0.85 * sum(r for i, r in rank.items() if i not in out)) / len(ids)
        after = dict.fromkeys(ids, base)
        for a, b in ends:
            after[b] += 0.85 * rank[a] / out[a]
        rank = after
    most = max(rank.values())
    got = {r["node_id"]: r["rank"] for r in QUERIES["pagerank_all"](spark, sf).collect()}
    assert got.keys() == ids and all(abs(got[i] - rank[i] / most) < 1.1e-4 for i in ids)


def test_pagerank(spark):
    n = spark.createDataFrame([("a",), ("b",), ("hub",)], "node_id string")
    e = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("hub", "a"), ("a", "nowhere")], "source_id string, target_id string")
    ranks = {r["node_id"]: r["rank"] for r in graphs.pagerank(n, e).collect()}
    assert ranks["hub"] == 1.0 and ranks["a"] > ranks["b"] and ranks["b"] < 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in graphs.components(links).collect()}
    assert all(found[i] == 0 for i in range(61)) and found[101] == 100
    assert graphs.components(links.limit(0)).count() == 0


def test_paths(spark):
    n = nodes_of(spark, {"node_id": "alice", "node_type": "user", "name": "alice"}, {"node_id": "pr", "node_type": "pull_request", "name": "pr-42"}, {"node_id": "co", "node_type": "feature", "name": "checkout"}, {"node_id": "is", "node_type": "feature", "name": "island"})
    e = spark.createDataFrame([("alice", "pr", "AUTHORED"), ("pr", "co", "IMPLEMENTS")], "source_id string, target_id string, relationship string")
    asked = spark.createDataFrame([("alice", "co"), ("alice", "is")], "start_id string, target_id string")
    got = graphs.find_path(e, n, asked, 4).collect()
    assert [(r["target_id"], r["depth"], r["path"]) for r in got] == [("co", 2, "alice -[AUTHORED]-> pr-42 -[IMPLEMENTS]-> checkout")]


def test_paths_from_both_ends_are_the_walk_s(spark):
    import random

    rng = random.Random(4)
    ids = [f"n{i}" for i in range(40)]
    n = nodes_of(spark, *({"node_id": i, "node_type": "t", "name": f"{rng.choice('xyz')}"} for i in ids))
    links = {(*rng.sample(ids[:36], 2), rng.choice("RST")) for _ in range(45)} | {("n0", f"n{i}", "R") for i in range(20, 34)}
    e = spark.createDataFrame(sorted(links), "source_id string, target_id string, relationship string")
    pairs = spark.createDataFrame([(a, b) for a in ids[::3] for b in ids] + [("n1", "n2"), ("n1", "gone"), ("gone", "gone"), (None, "n1")], "start_id string, target_id string")
    for visible, depth in ((None, 4), (n.where("node_id not in ('n0', 'n3', 'n5', 'n22')").select("node_id"), 3), (None, 1)):
        walked = graphs.first_arrivals(e, n, pairs.select("start_id").distinct(), depth, visible)
        want = walked.join(pairs.distinct().withColumnRenamed("target_id", "node_id"), ["start_id", "node_id"]).select("start_id", F.col("node_id").alias("target_id"), "depth", text.render_path(F.col("names"), F.col("rels")).alias("path"))
        got = sorted(map(tuple, graphs.find_path(e, n, pairs, depth, visible).collect()))
        assert got == sorted(map(tuple, want.collect())) and {r[2] for r in got} == set(range(depth + 1))
    assert graphs.find_path(e, n, pairs.limit(0), 4).count() == 0


def test_all_simple_paths_or_none(spark):
    import random

    rng = random.Random(9)
    ids = [f"n{i}" for i in range(12)]
    n = nodes_of(spark, *({"node_id": i, "node_type": "tu"[k % 2], "name": i.upper()} for k, i in enumerate(ids)))
    links = {(rng.choice(ids), rng.choice(ids), rng.choice("RS")) for _ in range(26)} | {("n0", "n0", "R")}
    e = spark.createDataFrame(sorted(links), "source_id string, target_id string, relationship string")
    starts = spark.createDataFrame([("n0",), ("n5",), ("n5",), ("gone",), (None,)], "start_id string")
    steps = {(a, b, ">" + r) for a, b, r in links} | {(b, a, "<" + r) for a, b, r in links}
    for seen in (set(ids), set(ids) - {"n1", "n5", "n7"}):
        want, front = [], [([s], []) for s in ("n0", "n5")]
        for _ in range(3):
            front = [([*p, b], [*rels, r]) for p, rels in front for a, b, r in steps if a == p[-1] and b not in p and b in seen]
            want += front
        visible = n.where(F.col("node_id").isin(*seen)).select("node_id")
        got = graphs.simple_paths(e, n, starts, 3, visible, most_rows=100_000).where("depth > 0").collect()
        assert sorted((r["names"], r["rels"]) for r in got) == sorted(([i.upper() for i in p], rels) for p, rels in want)
        to = graphs.traverse_to_type(e, n, starts, "u", 3, 100_000, visible, all_paths=True).collect()
        assert len(to) == sum(int(p[-1][1:]) % 2 for p, _ in want)
    with pytest.raises(graphs.TooManyPaths):
        graphs.simple_paths(e, n, starts, 3, most_rows=10)


def test_canonical_cycle_ends(spark):
    n = nodes_of(spark, {"node_id": "a", "node_type": "t", "name": "a", "canonical_node_id": "b"}, {"node_id": "b", "node_type": "t", "name": "b", "canonical_node_id": "a"}, {"node_id": "c", "node_type": "t", "name": "c", "canonical_node_id": "d"}, {"node_id": "d", "node_type": "t", "name": "d"})
    assert {r["node_id"]: r["root"] for r in reads.resolve_canonical(n).collect()} == {"a": "a", "b": "a", "c": "d", "d": "d"}


def test_visibility_grows_with_grants(spark):
    docs = spark.createDataFrame([("d1", "github", "r"), ("d2", "slack", "c")], "document_id string, source_system string, resource_key string")
    m = spark.createDataFrame([("feature", "d1", ""), ("thread", "d2", "")], schema.MENTIONS)
    g = spark.createDataFrame([("dev", "github", None), ("all", "slack", "c")], schema.GRANTS)
    seen = lambda *groups: {r[0] for r in visibility.visible_node_ids(m, docs, g, list(groups)).collect()}
    assert seen() == set() and seen("dev") == {"feature"} and seen("dev", "all") == {"feature", "thread"}


def test_dedup_scan(spark):
    n = nodes_of(spark, {"node_id": "1", "node_type": "user", "name": "alice", "source_system": "github", "external_id": "a"}, {"node_id": "2", "node_type": "user", "name": "alice", "source_system": "slack", "external_id": "b"}, {"node_id": "3", "node_type": "user", "name": "alice2", "source_system": "github", "external_id": "c"})
    m = spark.createDataFrame([("1", "d", "")], schema.MENTIONS)
    found = scans.scan_dedup(n.where("node_id < '3'"), m).collect()
    assert [(r["payload"]["winner_id"], r["confidence"]) for r in found] == [("1", 1.0)]
    assert scans.scan_dedup(n.where("node_id <> '2'"), m).count() == 0
    said = spark.createDataFrame([("1:2", "different", 0.9)], "dedup_key string, verdict string, judged double")
    assert scans.scan_dedup(n.where("node_id < '3'"), m, judgments=said).count() == 0
    queue = proposals.submit(spark.createDataFrame([], schema.PROPOSALS), scans.scan_dedup(n.where("node_id < '3'"), m), F.lit("2024-01-01").cast("timestamp"))
    assert proposals.submit(queue, scans.scan_dedup(n.where("node_id < '3'"), m), F.lit("2024-01-02").cast("timestamp")).count() == queue.count() == 1


def test_lines_of_stripped_html(spark):
    import html
    import re

    pieces = ["<p>a</p>", "\r\n", "\r", "&nbsp;", "\u00a0", " b ", "\t", "\u2028", "\x0b", "\x1c", "\x85", "\u3000", "<br/>", "<b>c  d</b>", "&amp;", "\u200b", "\x1f", "e"]
    import random

    rng = random.Random(2)
    texts = ["<p>a</p>\r\n<p>&nbsp;</p>b \r\n", "", None] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(200)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in d.select("t", text.strip_html(F.col("t")).alias("s")).collect():
        lines = html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<(?:/p|br\s*/?|/h[1-6]|/li|/tr|/div)>", "\n", r["t"] or ""))).splitlines()
        assert r["s"] == "\n".join(x for x in (re.sub(r"[ \t]+", " ", line).strip() for line in lines) if x), repr(r["t"])


def test_audit_of_many_results(spark):
    rows = spark.range(500).select(F.lit("r").alias("request_id"), F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("node_id")).unionByName(spark.createDataFrame([("q", "x"), ("q", None)], "request_id string, node_id string"))
    none = F.lit(None).cast("string")
    out = {r["request_id"]: r for r in dumps.audit_rows(rows, none, none, "t", none, F.current_timestamp(), 100).collect()}
    assert out["r"]["result_count"] == 500 and out["r"]["result_ids"] == [f"n{i:04}" for i in range(100)] and (out["q"]["result_count"], out["q"]["result_ids"]) == (2, ["x"])


def test_edge_ledger_takes_batches_in_any_order_and_again(spark):
    rows = [("a", "b", "R", 0.5, "d1", {"x": "1"}, 1), ("a", "b", "R", 0.7, "d2", {"y": "1"}, 2), ("a", "c", "R", 0.2, "d2", {}, 3)], [("a", "b", "R", 0.6, "d3", {"x": "2"}, 4), ("c", "b", "R", 0.1, "d3", {}, 5)]
    one_, two = (spark.createDataFrame(r, "source_id string, target_id string, relationship string, confidence double, evidence_document_id string, properties map<string,string>, seq long") for r in rows)
    want = {("a", "b"): (3.0, 0.7, "d3", {"x": "2", "y": "1"}), ("a", "c"): (1.0, 0.2, "d2", {}), ("c", "b"): (1.0, 0.1, "d3", {})}
    for order in ("12", "21", "1121", "2212"):
        ledger = None
        for b in order:
            ledger = resolve.record_edges(ledger, one_ if b == "1" else two, b)
        assert {(r["source_id"], r["target_id"]): (r["weight"], r["confidence"], r["evidence_document_id"], r["properties"]) for r in resolve.edges_of(ledger).collect()} == want


def test_contradictions(spark):
    n = nodes_of(spark, {"node_id": "a", "node_type": "t", "name": "a", "properties": {"owner": "alice", "tier": "1", "n": "1.0"}}, {"node_id": "b", "node_type": "t", "name": "b", "canonical_node_id": "a", "properties": {"owner": "bob", "tier": "1", "stale": "true", "n": "1"}})
    assert [r["payload"]["key"] for r in scans.scan_contradictions(n).collect()] == ["owner"]


def planted_clusters(seed, clusters, each, dim=24, spread=0.06):
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), each, 0)
    return v + rng.normal(size=v.shape) * spread


def near_pairs(x, y, most):
    """Index pairs within a cosine distance, by brute force."""
    import numpy as np

    x, y = (np.divide(m, n, out=np.zeros_like(m), where=n > 0) for m in (x, y) for n in [np.linalg.norm(m, axis=1, keepdims=True)])
    return set(zip(*(k.tolist() for k in np.nonzero(1 - x @ y.T <= most + 1e-12))))


def vector_rows(spark, v, prefix="n"):
    return spark.createDataFrame([(f"{prefix}{i:05}", "tu"[i % 2], [float(x) for x in row]) for i, row in enumerate(v)], "node_id string, node_type string, embedding array<double>")


@pytest.mark.parametrize("most", [0.0, 0.2, 0.6, 1.2])
def test_vector_pairs_in_cells(spark, most):
    import numpy as np

    v = planted_clusters(3, 30, 8)
    v[5], v[6], v[17] = 0, 0, v[18]
    want = {(f"n{i:05}", f"n{j:05}") for i, j in near_pairs(v, v, most) if i < j}
    rows = vector_rows(spark, v).unionByName(spark.createDataFrame([("none", "t", None)], "node_id string, node_type string, embedding array<double>"))
    for block_rows in (16, 2048):
        got = [(r["a"], r["b"]) for r in resolve.vector_pairs(rows, most, block_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    same = {(r["a"], r["b"]) for r in resolve.vector_pairs(rows, most, 16, same_type=True).collect()}
    assert same == {(a, b) for a, b in want if int(a[1:]) % 2 == int(b[1:]) % 2}
    w = planted_clusters(3, 30, 2, spread=0.02)
    both = {(r["a"], r["b"]) for r in resolve.vector_pairs(rows, most, 16, asked=vector_rows(spark, w, "q")).collect()}
    assert both == {(f"q{j:05}", f"n{i:05}") for i, j in near_pairs(v, w, most)}
    assert resolve.vector_pairs(rows.limit(0), most).collect() == []


def test_vectors_are_copied_to_near_cells_only(spark):
    v = planted_clusters(11, 120, 25, dim=48, spread=0.03)
    rows = vector_rows(spark, v)
    copies = {most: resolve.in_cells(rows, most, 32).where("not home").count() / len(v) for most in (0.02, 0.2, 0.6, 1.0)}
    assert copies[0.02] < 2 and copies[0.2] < 10 and copies[1.0] > 40, copies
    # known rows are never copied when new ones are asked
    asked = resolve.in_cells(rows, 0.2, 32, vector_rows(spark, v[:50], "q"))
    assert asked.where("not home and node_id like 'n%'").count() == 0 and asked.where("home and node_id like 'q%'").count() == 0


def test_known_names_never_meet_each_other(spark):
    names = spark.createDataFrame([("t", f"billing service {i}") for i in range(40)], "node_type string, name string")
    new = spark.createDataFrame([("t", "billing service 7"), ("t", "billing servces 3"), ("t", "other")], "node_type string, name string")
    got = {(r["a"], r["b"]): r["similarity"] for r in resolve.name_pairs(new, 0.5, names).collect()}
    every = resolve.name_pairs(new.unionByName(names), 0.5).collect()
    asked = {r["name"] for r in new.collect()}
    known = {r["name"] for r in names.collect()}
    want = {(x, y): r["similarity"] for r in every for x, y in ((r["a"], r["b"]), (r["b"], r["a"])) if x in asked and y in known and x != y}
    assert got == want and len(got) > 40


def merge_graph(spark):
    n = nodes_of(spark, {"node_id": "w", "node_type": "t", "name": "w", "properties": {"status": "live"}}, {"node_id": "l", "node_type": "t", "name": "l", "properties": {"status": "old", "owner": "alice"}, "summary": "s"}, {"node_id": "o", "node_type": "t", "name": "o"}, {"node_id": "s", "node_type": "t", "name": "s"}, {"node_id": "x", "node_type": "u", "name": "x"})
    e = spark.createDataFrame([("w", "s", "R", 2.0, 0.5, None, {"k": "w"}), ("l", "s", "R", 3.0, 0.9, "d", {"k": "l", "j": "l"}), ("l", "w", "R", 1.0, 1.0, None, {}), ("o", "l", "R", 1.0, 1.0, None, {}), ("o", "s", "R", 1.0, 1.0, None, {})], schema.EDGES)
    m = spark.createDataFrame([("w", "d1", "c"), ("l", "d1", "x"), ("l", "d2", "y")], schema.MENTIONS)
    return n, e, m


def test_merge_and_rollback(spark):
    n, e, m = merge_graph(spark)
    merges = spark.createDataFrame([("p1", "w", "l", 0.9), ("p2", "o", "l", 0.8), ("p3", "w", "w", 0.9), ("p4", "w", "x", 0.9)], "proposal_id string, winner_id string, loser_id string, confidence double")
    done = proposals.apply_entity_merge(n, e, m, merges)
    assert {r["proposal_id"]: r["error"] for r in done.errors.collect()} == {"p2": "already merged", "p3": "cannot merge a node into itself", "p4": "cannot merge across types"}
    edges = {(r["source_id"], r["target_id"]): r for r in done.edges.collect()}
    assert set(edges) == {("w", "s"), ("o", "w"), ("o", "s")}
    assert (edges["w", "s"]["weight"], edges["w", "s"]["confidence"], edges["w", "s"]["properties"]) == (5.0, 0.9, {"k": "w", "j": "l"})
    assert {(r["node_id"], r["document_id"], r["context"]) for r in done.mentions.collect()} == {("w", "d1", "c"), ("w", "d2", "y")}
    won = {r["node_id"]: r for r in done.nodes.collect()}
    assert won["w"]["properties"] == {"status": "live", "owner": "alice"} and won["w"]["summary"] == "s" and won["l"]["canonical_node_id"] == "w"
    for before, after in zip((n, e, m), proposals.rollback_entity_merge(done, done.nodes, done.edges, done.mentions)):
        key = lambda df: sorted(map(repr, df.collect()))
        assert key(before) == key(after.select(before.columns))
    with pytest.raises(ValueError):
        proposals.rollback_entity_merge(done, n, e, m)


def one_after_another(nodes, edges, mentions, merges):
    """Plain Python: merges by order, each on what the ones before have left."""
    alias, errors = {}, {}
    for p, w, l, c in sorted(merges, key=lambda r: (-r[3], r[0])):
        if w == l or w not in nodes or l not in nodes or nodes[w]["type"] != nodes[l]["type"] or w in alias or l in alias:
            errors[p] = True
            continue
        for key in [k for k in edges if l in k[:2]]:
            row = edges.pop(key)
            to = tuple(w if x == l else x for x in key[:2]) + key[2:]
            if to[0] == to[1]:
                continue
            twin = edges.get(to)
            edges[to] = (twin[0] + row[0], max(twin[1], row[1])) if twin else row
        for n, d in [m for m in mentions if m[0] == l]:
            mentions.discard((n, d))
            mentions.add((w, d))
        nodes[w]["properties"] = {**nodes[l]["properties"], **nodes[w]["properties"]}
        nodes[w]["summary"] = nodes[w]["summary"] or nodes[l]["summary"]
        nodes[w]["confidence"] = max(nodes[w]["confidence"], nodes[l]["confidence"])
        alias[l] = w
    return alias, errors


def test_merges_of_a_batch_are_done_one_after_another(spark):
    import random

    rng = random.Random(7)
    for round_ in range(4):
        ids = [f"n{i:02}" for i in range(14)]
        plain = {i: {"type": rng.choice("ttttu"), "properties": {rng.choice("xyz"): i for _ in range(2)}, "summary": rng.choice([None, f"s {i}"]), "confidence": rng.random()} for i in ids}
        edges = {(a, b, "R"): (float(rng.randint(1, 5)), rng.random()) for a in ids for b in ids if a != b and rng.random() < 0.2}
        mentions = {(i, f"d{rng.randrange(6)}") for i in ids for _ in range(2)}
        merges = [(f"p{k:02}", *rng.sample(ids, 2), rng.choice([0.7, 0.8, 0.9])) for k in range(12)]
        if not round_:  # a star, and a chain
            merges = [("p1", "n00", "n01", 0.9), ("p2", "n00", "n02", 0.8), ("p3", "n00", "n03", 0.7), ("q1", "n04", "n05", 0.9), ("q2", "n05", "n06", 0.8), ("q3", "n06", "n07", 0.7), ("r1", "n08", "n00", 0.1)]
            plain = {i: v | {"type": "t"} for i, v in plain.items()}
        n = nodes_of(spark, *({"node_id": i, "node_type": v["type"], "name": i, "properties": v["properties"], "summary": v["summary"], "confidence": v["confidence"]} for i, v in plain.items()))
        e = spark.createDataFrame([(*k, w, c, None, {}) for k, (w, c) in edges.items()], schema.EDGES)
        m = spark.createDataFrame([(i, d, "c") for i, d in mentions], schema.MENTIONS)
        done = proposals.apply_entity_merge(n, e, m, spark.createDataFrame(merges, "proposal_id string, winner_id string, loser_id string, confidence double"))
        alias, errors = one_after_another(plain, edges, mentions, merges)
        assert {r["old_id"]: r["new_id"] for r in done.mapping.collect()} == alias and {r["proposal_id"] for r in done.errors.collect()} == set(errors)
        assert {(r["source_id"], r["target_id"], "R"): (r["weight"], r["confidence"]) for r in done.edges.collect()} == edges
        assert {(r["node_id"], r["document_id"]) for r in done.mentions.collect()} == mentions
        for r in done.nodes.collect():
            own = plain[r["node_id"]]
            assert (r["canonical_node_id"], r["properties"], r["summary"], r["confidence"]) == (alias.get(r["node_id"]), own["properties"], own["summary"], own["confidence"])
        if not round_:
            assert alias == {"n01": "n00", "n02": "n00", "n03": "n00", "n05": "n04", "n07": "n06", "n00": "n08"}
        for before, after in zip((n, e, m), proposals.rollback_entity_merge(done, done.nodes, done.edges, done.mentions)):
            assert sorted(map(repr, before.collect())) == sorted(map(repr, after.select(before.columns).collect()))


def test_rollback_names_what_has_changed(spark):
    n, e, m = merge_graph(spark)
    done = proposals.apply_entity_merge(n, e, m, spark.createDataFrame([("p1", "w", "l", 0.9)], "proposal_id string, winner_id string, loser_id string, confidence double"))
    later = done.nodes.withColumn("summary", F.when(F.col("node_id") == "w", "newer").otherwise(F.col("summary")))
    with pytest.raises(ValueError, match="changed since: w$"):
        proposals.rollback_entity_merge(done, later, done.edges, done.mentions)
    with pytest.raises(ValueError, match="o w R"):
        proposals.rollback_entity_merge(done, done.nodes, done.edges.where("source_id <> 'o'"), done.mentions)
    unrelated = done.nodes.withColumn("summary", F.when(F.col("node_id") == "s", "newer").otherwise(F.col("summary")))
    assert proposals.rollback_entity_merge(done, unrelated, done.edges, done.mentions)[0].where("node_id = 's'").first()["summary"] == "newer"


def test_decisions(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    found = spark.createDataFrame([Row(kind="k", payload={"a": "1"}, confidence=c, agent="x", evidence={}, dedup_key=d) for c, d in ((0.95, "a"), (0.5, "b"))], "kind string, payload map<string,string>, confidence double, agent string, evidence map<string,string>, dedup_key string")
    queue = proposals.submit(spark.createDataFrame([], schema.PROPOSALS), found, now, 0.9)
    assert sorted(r["status"] for r in queue.collect()) == ["auto_applied", "pending"]
    asked = queue.select("proposal_id", F.lit("approve").alias("action"), F.lit("me").alias("reviewer"))
    after, bad = proposals.decide(queue, asked, now)
    assert sorted(r["status"] for r in after.collect()) == ["approved", "auto_applied"] and bad.count() == 1


def test_schema_types(spark):
    reg = extract.seed_node_types(spark)
    names = spark.createDataFrame([("gadget",), ("Bad Name",), ("user",)], "name string")
    after, errors = proposals.apply_schema_type(reg, names, "node_type")
    assert after.count() == 18 and errors.count() == 2
    back, refused = proposals.rollback_schema_type(after, names.where("name = 'gadget'"), spark.createDataFrame([("gadget",)], "node_type string"), "node_type")
    assert back.count() == 18 and refused.count() == 1


def test_wikilinks_reconcile(spark):
    files = spark.createDataFrame([("f", "Beta")], "node_id string, name string")
    concepts = spark.createDataFrame([("c1", "beta"), ("c2", "nonexistent-doc")], "node_id string, name string")
    e = spark.createDataFrame([("a", "c1", "REFERENCES", 1.0, 0.8, "d"), ("a", "c2", "REFERENCES", 1.0, 0.8, "d"), ("f", "c1", "REFERENCES", 1.0, 0.8, "d")], "source_id string, target_id string, relationship string, weight double, confidence double, evidence_document_id string")
    got = {(r["source_id"], r["target_id"], r["evidence_document_id"]) for r in resolve.redirect_edges(e, resolve.wikilink_mapping(files, concepts)).collect()}
    assert got == {("a", "f", None), ("a", "c2", "d")}


def test_transcripts_and_mail(spark):
    vtt = spark.createDataFrame([("m", "WEBVTT\n\n1\n00:01.000 --> 00:02.000\nAlice: hi\n\n00:03.000 --> 00:04.000\nBob: a: b\n\nno name")], "id string, vtt string")
    assert [(r["who"], r["said"]) for r in landed.vtt_turns(vtt).orderBy("pos").collect()] == [("Alice", "hi"), ("Bob", "a: b"), ("unknown", "no name")]
    raw = b"Subject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nContent-Type: text/html\n\n<p>a</p><p>b</p>"
    mail = landed.mailbox(spark.createDataFrame([("in", "7", bytearray(raw))], "folder string, uid string, content binary")).first()
    assert (mail["external_id"], mail["title"], mail["content"]) == ("in:7", "Grüße", "a\nb")


def test_dump_round_trip(spark, tmp_path):
    n, e, _ = merge_graph(spark)
    dumps.write_dump({"nodes": n, "edges": e}, f"{tmp_path}/d")
    back = dumps.read_dump(spark, f"{tmp_path}/d", {"nodes": schema.NODES, "edges": schema.EDGES})
    assert sorted(map(repr, back["nodes"].collect())) == sorted(map(repr, n.collect()))
    with pytest.raises(ValueError):
        dumps.read_dump(spark, f"{tmp_path}/d", {"nodes": schema.NODES})
    with pytest.raises(ValueError):
        dumps.read_dump(spark, f"{tmp_path}/d", {"nodes": schema.NODES, "edges": schema.EDGES}, {"nodes": n})


def test_query_language():
    assert search.parse_query('alpha -beta "red fox" OR the gamma') == [[(True, ["alpha"]), (False, ["beta"]), (True, ["red", "fox"])], [(True, ["gamma"])]]


def test_rate_limit():
    hits, out = [], []
    for t in (0, 10, 20, 60, 61, 90):
        ok, hits = replay.admitted(hits, t, 2, 60)
        out.append(ok)
    assert out == [True, True, False, False, True, True]
    assert replay.admitted([], 5, 0, 60)[0]


def test_rate_limit_stream(spark):
    from graphloom.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    hits, want = {}, {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).orderBy("at", "event_id").collect():
        kept = [t for t in hits.get(r["user_id"], []) if r["at"] - t <= 86_400_000_000]
        want[r["event_id"]] = len(kept) < 2
        hits[r["user_id"]] = kept + [r["at"]] * (len(kept) < 2)
    got = {r["event_id"]: r["allowed"] for r in QUERIES["stream_rate_limit"](spark, sf).collect()}
    assert got == want and len(set(want.values())) == 2


def test_filed_findings_take_no_room(spark):
    n = nodes_of(spark, *({"node_id": str(i), "node_type": "t", "name": f"n{i}"} for i in range(6)))
    e = spark.createDataFrame([("0", "1", "R")], "source_id string, target_id string, relationship string")
    m = spark.createDataFrame([("2", "d", "")], schema.MENTIONS)
    queue = proposals.submit(spark.createDataFrame([], schema.PROPOSALS), scans.scan_orphans(n, e, m, 1), F.lit("2024-01-01").cast("timestamp"))
    queue = queue.withColumn("status", F.lit("rejected"))
    assert [r["dedup_key"] for r in queue.collect()] == ["3"]
    assert [r["dedup_key"] for r in scans.scan_orphans(n, e, m, 1, queue).collect()] == ["4"]
    assert scans.scan_orphans(n, e, m, 1, queue, limit_before_filed=True).count() == 0
    assert scans.scan_orphans(n.limit(0), e, m).count() == 0


def test_contradictions_that_are_filed_take_no_room(spark):
    pairs = [({"node_id": f"a{i}", "node_type": "t", "name": f"a{i}", "properties": {"k": "1", "l": "1"}}, {"node_id": f"b{i}", "node_type": "t", "name": f"b{i}", "canonical_node_id": f"a{i}", "properties": {"k": "2", "l": "2"}}) for i in range(3)]
    n = nodes_of(spark, *(x for p in pairs for x in p))
    first = scans.scan_contradictions(n, 1)
    assert sorted(r["dedup_key"] for r in first.collect()) == ["a0:b0:k", "a0:b0:l"]
    queue = proposals.submit(spark.createDataFrame([], schema.PROPOSALS), first, F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r["dedup_key"] for r in scans.scan_contradictions(n, 1, queue).collect()) == ["a1:b1:k", "a1:b1:l"]
    assert scans.scan_contradictions(n, 1, queue, True).count() == 0


def test_entities_and_broken_text(spark):
    d = spark.createDataFrame([(1, "caf&eacute; &#8217;x&#x2019; &hellip;", b"a\xffb\xc3\xa9"), (2, None, None), (3, "<b>plain</b>", b"ok")], "i int, t string, b binary")
    got = {r["i"]: (r["t"], r["b"]) for r in d.select("i", text.strip_html(F.col("t")).alias("t"), text.decoded(F.col("b")).alias("b")).collect()}
    assert got == {1: ("caf\u00e9 \u2019x\u2019 \u2026", "ab\u00e9"), 2: ("", None), 3: ("plain", "ok")}


def test_derived_names_and_vectors(spark):
    none = "external_id string, canonical_node_id string"
    known = spark.createDataFrame([("k1", "t", "checkout flow", [1.0, 0.0], None, None), ("k2", "t", "billing", [0.0, 1.0], None, "k9"), ("k3", "t", "search index", None, None, None)], f"node_id string, node_type string, name string, embedding array<double>, {none}")
    new = spark.createDataFrame([("t", "payments", [0.05, 1.0], 1), ("t", "checkout flows", [0.0, 1.0], 2), ("t", "search indexes", None, 3), ("t", "other", [-1.0, 0.1], 4), ("t", "thing", [-1.0, 0.0], 5), ("u", "billing", None, 6)], "node_type string, name string, embedding array<double>, seq int")
    got = {(r["node_type"], r["name"]): (r["node_id"], r["change"]) for r in resolve.resolve_derived(known, new).collect()}
    # a new name with a vector takes the nearest vector even if another name is more alike
    assert got["t", "payments"] == ("k9", "enriched") and got["t", "checkout flows"] == ("k9", "enriched") and got["t", "search indexes"] == ("k3", "enriched")
    assert got["t", "other"][1] == "created" and got["t", "thing"] == (got["t", "other"][0], "merged") and got["u", "billing"][1] == "created"


def test_names_resolved_one_after_another(spark):
    import random

    import numpy as np

    def grams(name):
        return {f"  {w} "[i : i + 3] for w in name.split() for i in range(len(w) + 1)}

    rng, words = random.Random(12), ["alpha", "alphas", "beta", "betas", "gamma", "delta"]
    name = lambda: " ".join(rng.choices(words, k=rng.choice((1, 2, 2, 3))))
    vector = lambda: rng.choice((None, [round(rng.gauss(0, 1), 3) for _ in range(3)]))
    old = [(f"k{i}", rng.choice("tu"), name(), vector(), rng.choice((None, None, "x")), rng.choice((None, None, f"c{i}"))) for i in range(8)]
    new = [(rng.choice("tu"), name(), vector(), i) for i in range(60)]
    schema = "node_id string, node_type string, name string, embedding array<double>, external_id string, canonical_node_id string"
    known, incoming = spark.createDataFrame(old, schema), spark.createDataFrame(new, "node_type string, name string, embedding array<double>, seq int")

    def brute(use_vectors):
        held = [(k, t, m, v if use_vectors else None, c or k, True) for k, t, m, v, x, c in old if x is None]
        first, out = {}, {}
        for t, m, v, _ in new:
            first.setdefault((t, m), None)
            if first[t, m] is None and use_vectors:
                first[t, m] = v
        for (t, m), v in first.items():
            options = []
            for _, kind, other, w, to, known_one in held:
                far = None if v is None or w is None else round(1 - float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12)
                like = round(len(grams(m) & grams(other)) / len(grams(m) | grams(other)), 12)
                if kind == t and (like >= 0.55 or (far is not None and far <= 0.15)):
                    options.append((far is None, far or 0, -like, to, not known_one))
            if options:
                out[t, m] = (min(options)[3], "merged" if min(options)[4] else "enriched")
            else:
                made = hashlib.sha256(f"{t}|{m}".encode()).hexdigest()
                out[t, m] = (made, "created")
                held.append((made, t, m, v, made, False))
        return out

    for use in (True, False):
        a, b = (known, incoming) if use else (known.drop("embedding"), incoming.drop("embedding"))
        got = {(r["node_type"], r["name"]): (r["node_id"], r["change"]) for r in resolve.resolve_derived(a, b, strategy="sequential").collect()}
        assert got == brute(use) and {c for _, c in got.values()} == {"created", "merged", "enriched"}
    assert resolve.resolve_derived(known, incoming.limit(0), strategy="sequential").count() == 0
    with pytest.raises(ValueError):
        resolve.resolve_derived(known, incoming, strategy="other")


def test_same_names_of_one_source_never_meet(spark):
    rows = [{"node_id": f"{s}{i}", "node_type": "t", "name": "same", "source_system": s, "external_id": str(i)} for s in ("a", "b") for i in range(3)]
    rows += [{"node_id": f"n{i}", "node_type": "t", "name": "same"} for i in range(2)]
    got = {(r["a"], r["b"]) for r in scans.fuzzy_pairs(nodes_of(spark, *rows), 0.45).collect()}
    ids = [(r["node_id"], r.get("source_system")) for r in rows]
    assert got == {tuple(sorted((i, j))) for i, s in ids for j, t in ids if i != j and (s is None or t is None or s != t)}


def test_view_of_a_neighbourhood(spark):
    n = nodes_of(spark, *({"node_id": i, "node_type": "t", "name": i} for i in "abcd"))
    e = spark.createDataFrame([("a", "b", "R"), ("c", "b", "R"), ("c", "d", "R")], "source_id string, target_id string, relationship string")
    starts = spark.createDataFrame([("a",)], "start_id string")
    ids = lambda depth: sorted(r["payload"][7] for r in dumps.graph_view(n, e, 10, starts, depth).where("kind = 'node'").collect())
    assert ids(1) == ["a", "b"] and ids(2) == ["a", "b", "c"]


def test_ranks_in_groups_of_any_size(spark):
    rows = [(k, i % 7, i) for k, n in (("a", 500), (None, 200), ("b", 3)) for i in range(n)]
    d = spark.createDataFrame(rows, "k string, v int, i int")
    got = {(r["k"], r["i"]): r["rank"] for r in reads.wide_ranks(d, ["k"], [F.col("v").desc(), F.col("i")]).collect()}
    want = {(k, i): n for key in ("a", "b", None) for n, (k, _, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1)}
    assert got == want


def ten_files(spark, folder):
    """Forty hours of hits of three users, four hours in a file, files in order of time."""
    import time

    for k in range(10):
        hits = spark.range(k * 240, k * 240 + 240).selectExpr("id", "cast(id % 3 as int) as user", "timestamp_seconds(1700000000 + id * 60) as ts").coalesce(1)
        hits.write.mode("append").parquet(folder)
        time.sleep(0.02)  # files are read in order of their time
    return spark.read.parquet(folder)


def test_windows_are_emitted_once_and_leave_the_state(spark, tmp_path):
    rows = ten_files(spark, f"{tmp_path}/hits")
    count = lambda df: df.groupBy(F.window("ts", "1 hour"), "user").agg(F.count(F.lit(1)).alias("n"))
    told = []
    got = replay.windows_drained(replay.replay(spark, f"{tmp_path}/hits", 1), "ts", lambda e: count(e.withWatermark("ts", "1 hour")), told)
    assert sorted(map(str, got.collect())) == sorted(map(str, count(rows).collect()))
    held = [s["numRowsTotal"] for p in told for s in p["stateOperators"]]
    assert len(held) >= 10 and max(held) <= 3 * 6 and held[-1] == 1  # six open hours of three users; the end's own window
    assert all(s["numRowsDroppedByWatermark"] == 0 for p in told for s in p["stateOperators"])


def test_streams_without_files(spark, tmp_path):
    spark.range(0).selectExpr("id", "timestamp_seconds(id) as ts", "cast(id as string) as content").write.parquet(f"{tmp_path}/none")
    for path in (f"{tmp_path}/none", f"{tmp_path}/none/*.none"):
        stream = spark.readStream.schema("id long, ts timestamp, content string").parquet(path)
        windows = replay.windows_drained(stream, "ts", lambda e: e.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")))
        assert windows.collect() == [] and windows.columns == ["window", "n"]
        image = replay.upsert_stream(stream, lambda b: b.groupBy("id").agg(F.max("content").alias("content"), F.min("ts").alias("ts")), ["id"], ["ts"])
        assert image.collect() == [] and image.columns == ["id", "content", "ts"]


def test_upserts_write_what_comes_not_the_image(spark, tmp_path):
    import time

    # a large first file, then twelve small ones that touch a few of its documents and bring a new one each
    batches = [[(f"d{i}", f"first {i}", 0) for i in range(3000)]] + [[(f"d{k}", f"again {k}", k), ("d0", f"turn {k}", k), (f"e{k}", "new", k), (f"e{k}", "newer", k + 1)] for k in range(1, 13)]
    want = {}
    for rows in batches:
        spark.createDataFrame(rows, "external_id string, content string, seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
        time.sleep(0.02)
        want |= {name: content for name, content, _ in sorted(rows, key=lambda r: r[2])}
    since = {name: [r[2] for rows in batches for r in rows if r[0] == name][0] for name in want}
    stream = spark.readStream.schema("external_id string, content string, seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/docs")
    stream = stream.select(F.lit("s").alias("source_system"), F.lit("t").alias("source_type"), "external_id", "content", F.timestamp_seconds(F.col("seq")).alias("source_created_at"), "seq")
    sizes = []
    image = replay.upsert_stream(stream, resolve.arrived_documents, resolve.DOC_KEY, ["source_created_at"], sizes=sizes)
    got = {r["external_id"]: r for r in image.select("external_id", "content", "content_hash", F.unix_seconds("source_created_at").alias("at")).collect()}
    assert {k: r["content"] for k, r in got.items()} == want
    assert all(got[k]["at"] == (since[k] + 1 if k[0] == "e" else since[k]) for k in want)  # of a batch the latest arrival
    assert len(sizes) == 13 and sorted(sizes)[-3] <= 30  # the image was written with its own batch and by one merge


def test_nearest_by_cells_is_exact_and_reads_few(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    hubs = rng.normal(size=(60, 16))
    v = np.repeat(hubs, 30, axis=0) + rng.normal(size=(1800, 16)) * 0.08
    v[7] = v[8] = v[9]  # ties
    v[20:24] = 0
    rows = [(f"v{i:04d}", [float(x) for x in r]) for i, r in enumerate(v)] + [("none", None)]
    vectors = spark.createDataFrame(rows, "node_id string, embedding array<double>")
    asked = {f"q{i}": v[i] for i in range(0, 1800, 20)} | {"far": -v.sum(0)}
    queries = spark.createDataFrame([(n, [float(x) for x in q]) for n, q in asked.items()] + [("nothing", None)], "request_id string, embedding array<double>")
    units = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
    for k, cell_rows in ((5, 30), (40, 100), (2000, 600), (3, 5000)):
        index = search.index_vectors(vectors, cell_rows)
        assert index.rows.count() == 1800 and index.cells["n"].sum() == 1800
        got = {}
        for r in search.nearest(index, queries, k, 64, 16).collect():
            got.setdefault(r["request_id"], []).append((r["rank"], r["node_id"], r["similarity"]))
        assert set(got) == set(asked)
        for name, q in asked.items():
            s = np.round(units @ (q / max(np.sqrt(q @ q), 1e-300)), 6)
            best = np.argsort(-s, kind="stable")[:k]
            mine = sorted(got[name])
            assert [m[0] for m in mine] == list(range(1, len(best) + 1))
            assert np.abs(np.array([m[2] for m in mine]) - s[best]).max() <= 1.5e-6
            if k == 3:
                assert [m[1] for m in mine] == [f"v{i:04d}" for i in best]
    index = search.index_vectors(vectors, 30)
    near = queries.where("request_id not in ('far', 'q20')")  # q20 is a vector of zeros, as near to all
    first = search.probes(index, near, 5).count()
    worst = search.nearest(index, near, 5).where("rank = 5").select("request_id", F.col("similarity").alias("worst"))
    further = search.probes(index, near.join(worst, "request_id"), 5).count()
    assert (first + further) / worst.count() <= 8  # of some sixty cells
    assert search.semantic_search(vectors.limit(0), queries, 3).count() == 0 == search.nearest(index, queries.limit(0), 3).count()


def test_searches_of_the_word_index_are_those_of_the_nodes(spark):
    import random

    rng = random.Random(6)
    rows = [(f"n{i}", rng.choice("abc"), " ".join(rng.choice("deploy deployed services Servant the copper coppers skies sky, news".split()) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    n = spark.createDataFrame([*rows, ("empty", None, None), ("stops", "a", "the of")], "node_id string, name string, body string")
    index = search.index_words(n)
    vocabulary = [r["word"] for r in index.postings.select("word").distinct().collect()]
    assert sorted(vocabulary) == sorted({"deploy", "servic", "servant", "copper", "sky", "news"} | set(vocabulary)) and len(vocabulary) <= 7
    for query in ("deploying services", '"copper sky" OR news -deploy', '-"deploy service" copper', "-copper -news", "unheard", "the", "", '"sky sky" OR "copper deploy copper"'):
        want = search.keyword_search(n.withColumn("summary", F.lit(None).cast("string")), query, 15, F.col("body")).collect()
        assert search.search_words(index, query, 15).collect() == want, query


def test_aliases_and_hidden_nodes_can_be_left_out(spark):
    n = nodes_of(spark, *({"node_id": i, "node_type": "t", "name": i, "canonical_node_id": {"b": "z"}.get(i)} for i in "abcdz"))
    e = spark.createDataFrame([("a", "b", "R", 1.0, 1.0), ("b", "c", "R", 1.0, 1.0), ("a", "d", "R", 1.0, 1.0), ("d", "z", "R", 1.0, 1.0), ("z", "c", "R", 1.0, 1.0)], "source_id string, target_id string, relationship string, confidence double, weight double")
    a = spark.createDataFrame([("a",)], "node_id string")
    near = lambda **how: [r["other_id"] for r in reads.neighbors(e, n, "out", 1, a, **how).collect()]
    assert near() == ["b"] and near(canonical_only=True) == ["d"]
    asked = spark.createDataFrame([("a", "c"), ("a", "b")], "start_id string, target_id string")
    assert {(r["target_id"], r["depth"]) for r in graphs.find_path(e, n, asked, 4).collect()} == {("c", 2), ("b", 1)}
    assert {(r["target_id"], r["depth"]) for r in graphs.find_path(e, n, asked, 4, canonical_only=True).collect()} == {("c", 3)}
    start = a.toDF("start_id")
    found = graphs.traverse_to_type(e, n, start, "t", 4, 9, canonical_only=True)
    assert [(r["node_id"], r["depth"]) for r in found.orderBy("depth", "node_id").collect()] == [("d", 1), ("z", 2), ("c", 3)]
    seen = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    assert {tuple(r) for r in reads.degrees(e, seen).collect()} == {("a", 1, 0), ("b", 1, 1), ("c", 0, 1)}
    assert {tuple(r) for r in reads.degrees(e).where("node_id = 'a'").collect()} == {("a", 2, 0)}
