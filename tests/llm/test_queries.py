"""The registered queries over whole small tables: against their SQL, or against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from graphloom.llm import exact_dedup, idmaps, jaccard, licenses, packing, queries, quotes, rules, token_rollup, toxicity, warc
from graphloom.session import new_path

SF = "/root/testdata/sf0.001"


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())


# --- 1


def test_training_is_plain_ftrl(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([rng.choice(words) for _ in range(12)] + ["bad"] * (i % 5 == 0))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    slots, weights, share = toxicity.fit_toxicity(docs, marks, epochs=2)
    learned = docs.where(~toxicity.held_out(F.col("doc_id"))).select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", "text").orderBy("k").collect()
    own = toxicity.Ftrl()
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= own.l1 else -(z[i] - np.sign(z[i]) * own.l1) / ((own.beta + n[i] ** 0.5) / own.alpha + own.l2)

    for _ in range(2):
        for r in learned:
            data = np.frombuffer(r["text"].encode(), np.uint8)
            at = set(toxicity._features(data, np.array([0, len(data)]))[0].tolist()) | {1 << toxicity.BITS}
            p = 1 / (1 + np.exp(-sum(map(weight, at))))
            g = p - (r["doc_id"] % 5 == 0)
            for i in at:
                w = weight(i)
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / own.alpha * w
                n[i] += g * g
    want = {i: weight(i) for i in z if weight(i)}
    assert want.keys() == set(slots.tolist()) and np.allclose([want[i] for i in slots.tolist()], weights)
    assert share == sum(r["doc_id"] % 5 == 0 for r in learned) / len(learned)


def test_toxicity_of_repeated_rows_and_labels(spark):
    rows = [(i, f"t{i} fine words here" if i % 3 else f"t{i} vile words here") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    one = toxicity.fit_toxicity(docs, marks)
    # repeated rows, later texts of an id and lower labels change nothing
    more = docs.unionByName(docs).unionByName(docs.select("doc_id", F.concat(F.lit("zzz "), "text").alias("text")))
    two = toxicity.fit_toxicity(more, marks.unionByName(marks.select("doc_id", F.lit(0).alias("toxic"))))
    assert one[2] == two[2] and np.array_equal(one[0], two[0]) and np.allclose(one[1], two[1])
    long = spark.createDataFrame([(1, "word " * 400_000), (1, "word " * 400_000)], "doc_id long, text string")
    assert len({r["score"] for r in toxicity.toxicity_scores(long, one).collect()}) == 1


def test_op1_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("toxic <> predicted").count() <= 0.1 * got.count()


# --- 2


def test_op2_by_brute_force(spark):
    import base64

    import tiktoken

    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = Counter()
    for version in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(public_tokenizers.path(f"{version}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for d in docs:
            quality, toxic = labels.get(d["doc_id"], (1, 0))
            if toxic == 1:
                continue
            text = d["text"] or ""
            if quality == 0:
                text = "\n".join(dict.fromkeys(text.split("\n")))
            want[d["source"], d["lang"], version, "n"] += 1
            want[d["source"], d["lang"], version, "t"] += len(enc.encode_ordinary(text))
    got = Counter()
    for r in queries.op2_token_counts(spark, SF).collect():
        got[r["source"], r["lang"], r["tokenizer_version"], "n"], got[r["source"], r["lang"], r["tokenizer_version"], "t"] = r["n_docs"], r["n_tokens"]
    assert got == want


# --- 3


def test_a_batch_committed_during_a_fold_counts_once(spark):
    rows = lambda *n: spark.createDataFrame([("s", "en", "v", 1, k) for k in n], "source string, lang string, tokenizer_version string, d_docs long, d_tokens long")
    store = token_rollup.TokenRollup(spark, new_path(spark, "rollup-test"))
    assert store.totals().collect() == []
    store.commit("a", rows(10))
    sums = store._sums

    def while_folding(*state):
        if "b" not in store.committed():
            store.commit("b", rows(10))
        return sums(*state)

    store._sums = while_folding
    store.fold()
    store._sums = sums
    total = [("s", "en", "v", 2, 20)]
    assert [tuple(r) for r in store.totals().collect()] == total
    store.fold()
    store.fold()
    assert not store.commit("a", rows(10)) and not store.commit("b", rows(10))
    assert [tuple(r) for r in store.totals().collect()] == total and store._state()[1:] == (["a", "b"], [])
    store.commit("c", rows(1))
    assert sorted({f.split("/deltas/")[1].split("/")[0] for f in store.totals().inputFiles() if "/deltas/" in f}) == ["c"]  # no other deltas are read


def brute_holders(held, asked):
    out = {}
    for c, k, t in asked:
        before = [u for d, key, u in held if d == c and key == k and u < t]
        if before:
            out[c, k, t] = max(before)
    return out


def test_latest_holders_in_any_block(spark):
    rng = random.Random(8)
    turns = [0, 1, 2, 1023, 1024, 1025, 5000, 1024 * 1024 - 1, 1024 * 1024, 1024 * 1024 + 1, 3 * 1024 * 1024, 10**9]
    held = {(1, rng.randrange(3), rng.choice(turns)) for _ in range(20)}
    asked = {(c, k, t) for c in (1, 2) for k in range(3) for t in turns}
    schema = "conv_id long, key long, turn long"
    got = quotes.latest_holders(spark.createDataFrame(sorted(held), schema), spark.createDataFrame(sorted(asked), schema))
    assert {(r["conv_id"], r["key"], r["turn"]): r["holder"] for r in got.collect()} == brute_holders(held, asked)


def test_wrapped_and_partial_quotes(spark):
    first = "The first sentence is here. The second one follows, and is long!\nA last line"
    rows = [
        (1, 0, "u", first), (1, 1, "u", "Something else entirely."),
        (1, 2, "u", "> The first sentence\n> is here. The second one\n> follows, and is long! A last line\nyes"),
        (1, 3, "u", "> The second one follows,\n> and is long!\nhm"), (1, 4, "u", "> A last line\nwhat"),
        (1, 5, "u", "On turn 3 X wrote:\n> On turn 2 Y wrote:\n> > The first sentence is here.\n> yes\n\nno"),
    ]
    m = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = {r["turn"]: (r["parent_turn"], r["root_turn"], r["depth"], r["n_links"], r["text"]) for r in quotes.conversations(m).collect()}
    assert got[2] == (0, 0, 1, 1, "yes") and got[3][:2] == (0, 0) and got[4][:2] == (0, 0) and got[5] == (2, 0, 2, 2, "\nno")
    long = spark.createDataFrame([(1, 0, "u", "word " * 200_000), (1, 1, "u", "> " + "word " * 200_000 + "\nlong")], "conv_id long, turn long, role string, text string")
    assert {(r["turn"], r["parent_turn"]) for r in quotes.conversations(long).collect()} == {(0, None), (1, 0)}


# --- 5


def test_most_shared_windows_are_placed_by_squares():
    rng = random.Random(1)
    w = packing.SquareSums(2048)
    lengths = {k: int(rng.lognormvariate(6, 1)) + 1 for k in range(4000)}
    for k, n in lengths.items():
        w.add(k, np.arange(n, dtype=np.uint32))
    placed = len(w.full)
    open_ones = {tuple(p[:2] for p in window) for level in w.open for window in level}
    w.close()
    # windows that were open are closed by one more piece each; few are taken apart
    kept = sum(tuple(p[:2] for p in window[:-k]) in open_ones for window in w.full[placed:] for k in (1, 2) if len(window) > k)
    assert placed + kept > 0.9 * len(w.full) and not w.counts.any(), (placed, kept, len(w.full))
    at = defaultdict(int)
    for doc, start, ids, total in sorted((p for window in w.full for p in window), key=lambda p: p[:2]):
        assert start == at[doc] == ids[0] and total == lengths[doc]
        at[doc] += len(ids)
    assert at == lengths
    # windows that are left open give up all their pieces
    w = packing.SquareSums(64)
    for k in range(9):
        w.add(k, np.zeros(30 + k, np.uint32))
    left = w.leave()
    assert sorted(p[0] for p in left + [p for window in w.full for p in window]) == list(range(9)) and not w.counts.any() and not w.leave()
    # levels are bounded even if no two pieces fit together
    w = packing.SquareSums(64)
    for k in range(3000):
        w.add(k, np.zeros(40, np.uint32))
        assert w.counts.max() <= packing.AT_LEVEL
    w.close()
    assert sum(len(p[2]) for window in w.full for p in window) == 3000 * 40


def test_small_partitions_fill_most_windows_by_squares(spark):
    rng = random.Random(2)
    texts = [(k, " ".join(rng.choices(["sun", "moon", "river", "42", "stone\n"], k=int(rng.lognormvariate(5.5, 1)) + 1))) for k in range(4000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(64)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for round_ids, most_cut in ((packing.ROUND_IDS, 0.3), (1 << 18, 0.7)):
        rows = packing.pack_documents(docs, path, public_tokenizers.PATTERN, round_ids=round_ids).collect()
        windows, own = defaultdict(list), defaultdict(list)
        for r in rows:
            windows[r["sequence_id"]].append(r)
            own[r["doc_id"]].append(r)
        for window in windows.values():
            window.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in window] == [sum(r["length"] for r in window[:k]) for k in range(len(window))] and len({r["placed"] for r in window}) == 1
        for pieces in own.values():
            pieces.sort(key=lambda r: r["start"])
            assert [r["start"] for r in pieces] == [sum(r["length"] for r in pieces[:k]) for k in range(len(pieces))] and sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]
        assert len(own) == 4000
        shared = [window for window in windows.values() if len(window) > 1]
        cut = sum(not window[0]["placed"] for window in shared)
        assert cut < most_cut * len(shared), (cut, len(shared))
        # only sequences closed at the end may be short, and those are powers of two
        sizes = [sum(r["length"] for r in window) for window in windows.values()]
        assert all(n & (n - 1) == 0 for n in sizes)


# --- 6


def test_revisits_name_the_record_they_refer_to(spark):
    pages = [("a/b <1>\n", "u", "x" * 70_000), ("", None, "y"), ("z:9", "u", "x" * 70_000), (None, "u", "y"), ("z:9", "u", "x" * 70_000)]
    p = spark.createDataFrame(pages, "page_id string, url string, html string")
    path = new_path(spark, "warc")
    warc.write_archives(p, path)
    rows = warc.read_archives(spark, path, "string").collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["intact"]) for r in rows) == {("a/b <1>\n", "revisit", "z:9", True): 1, ("", "response", None, True): 1, ("z:9", "response", None, True): 2, (None, "revisit", "", True): 1}
    import gzip

    files = [r["content"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()]
    text = b"".join(gzip.decompress(f) for f in files).decode()
    names = {x.split("> ")[0] for x in text.split("WARC-Record-ID: <")[1:]}
    names = {x.split(">")[0] for x in names}
    refers = {x.split(">")[0] for x in text.split("WARC-Refers-To: <")[1:]}
    assert refers and refers <= names


# --- 8


def brute_license(own, block):
    """The fewest words changed, added or missing of any stretch, if allowed."""
    limit, best = int(licenses.DIFFERING * len(own)), None
    for first in range(len(block)):
        row = [(0, 0)] + [None] * len(own)
        cost = [0] + [10**6] * len(own)
        for i, w in enumerate(own):
            cost[i + 1] = 10**6 if licenses.strict(w) else cost[i] + 1
        for word in block[first : first + len(own) + limit + 1]:
            if cost[-1] <= limit and (best is None or cost[-1] < best):
                best = cost[-1]
            new = [10**6 if licenses.strict(word) else cost[0] + 1]
            for i, w in enumerate(own):
                ways = [cost[i] if w == word else 10**6]
                if not licenses.strict(w) and not licenses.strict(word):
                    ways.append(cost[i] + 1)
                if not licenses.strict(word):
                    ways.append(cost[i + 1] + 1)
                if not licenses.strict(w):
                    ways.append(new[i] + 1)
                new.append(min(*ways, 10**6))
            cost = new
        if cost[-1] <= limit and (best is None or cost[-1] < best):
            best = cost[-1]
    return best


@pytest.mark.parametrize("name,pieces", [("GPL-3.0", 60), ("MPL-2.0", 200), ("ISC-permission", 2000)])
def test_licenses_with_a_word_of_many_pieces(name, pieces):
    own = licenses.TEMPLATES[name].split()
    own.insert(4, ".".join(f"x{i}" for i in range(pieces)))
    found = {f[0]: f for f in licenses.scan("before it " + " ".join(own) + " after it")[1]}
    assert found[name][3:] == (0, 1)


def test_usual_wordings_of_licenses():
    wordings = {
        "Licensed under Apache License 2.0": "Apache-2.0", "under the MIT License": "MIT", "Distributed under the terms of the GNU GPL v3": "GPL-3.0",
        "Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0", "Apache-2.0 OR MIT": "MIT", "MIT OR Apache-2.0": "Apache-2.0", "the GNU GPL version 3": "GPL-3.0",
        "BSD 3-Clause License": "BSD-3-Clause", "This project is licensed under the ISC License": "ISC", "Licensed under the Mozilla Public License 2.0": "MPL-2.0",
        "GNU General Public License v2.0": "GPL-2.0", "released under CC-BY-4.0": "CC-BY-4.0", "under the GNU Lesser General Public License v3.0": "LGPL-3.0", "GNU AGPL v3": "AGPL-3.0",
        "the Apache License, Version 2.0": "Apache-2.0", "Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0",
    }
    for text, name in wordings.items():
        assert name in [f[0] for f in licenses.scan(f"some words before. {text} and others after it")[1]], text
    for text in ("a license of mine", "the mit of the license", "apache tribe of two", "creative work of the commons"):
        assert licenses.scan(text)[1] == []


def test_licenses_equal_brute_force():
    rng = random.Random(12)
    filler = "the of a to and license under software notice copyright terms page text 2 mit".split()
    found = 0
    for _ in range(25):
        planted = rng.choice(list(licenses.TEMPLATES))
        own = licenses.TEMPLATES[planted].split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], [rng.choice(filler)], [own[at], rng.choice(filler)]])
        text = [rng.choice(filler) for _ in range(rng.randrange(30))] + own + [rng.choice(filler) for _ in range(rng.randrange(30))]
        text = rng.choice([" ", "\n", "  \n// "]).join(text)
        block = licenses.words(text)
        want = {}
        for n, t in [*licenses.TEMPLATES.items(), *licenses.WORDINGS]:
            if (e := brute_license(licenses.words(t), block)) is not None:
                want[n] = min(e, want.get(n, e))
        got = {}
        for starts, words, possible in licenses.candidate_blocks(text):
            for _, name, own in licenses.ranked(words, possible):
                if near := licenses.nearest(own, words):
                    got[name] = min(near[0], got.get(name, near[0]))
        assert got == want, text
        found += len(want)
    assert found > 15


def test_recall_of_altered_notices():
    rng = random.Random(3)
    hit = tried = 0
    for name, body in licenses.TEMPLATES.items():
        own = body.split()
        free = [i for i, w in enumerate(own) if len(licenses.words(w)) == 1 and not licenses.strict(licenses.words(w)[0])]
        limit = int(licenses.DIFFERING * len(licenses.words(body)))
        for k in range(5):
            changed = list(own)
            for i in rng.sample(free, min(limit // 2 + (limit > 0), len(free))):
                changed[i] = rng.choice(["other", "some", "xyz"])
            text = "lead in words\n" + " ".join(changed) + "\nand so on"
            tried += 1
            hit += name in [f[0] for f in licenses.scan(text)[1]]
    assert hit >= 0.9 * tried, (hit, tried)


def test_notices_without_cue_words():
    names = lambda t: [f[0] for f in licenses.scan(t)[1]]
    assert "SPDX-MIT" in names("# SPDX-License-Identifier: MIT")
    assert "BSD-opening" in names("Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions are met")
    assert "MIT-full" in names(licenses.TEMPLATES["MIT-full"].replace("free of charge", "at no charge").replace("sublicense", "relicense"))
    assert names("ünder the lïcence " * 2000) == []


# --- clashing columns


ODD_NAMES = "doc_id long, text string, _digest string, _rank int, _heavy int, _keep int, `a.b` string, `c``d` string, size int, _bit int"


def test_columns_of_any_name_pass(spark):
    texts = ["same text of a few words " * 4] * 3 + ["another text with other words " * 5, None, ""]
    d = spark.createDataFrame([(i, t, "d", 1, 2, 3, "ab", "cd", 4, 5) for i, t in enumerate(texts)], ODD_NAMES)
    for kept, ids in ((exact_dedup.distinct_documents(d), [2, 3, 5]), (jaccard.one_of_each(d), [0, 3, 4, 5]), (rules.passing(d, []), None), (toxicity.clean_documents(d, (np.empty(0, np.int64), np.empty(0), 0.0)), [0, 1, 2, 3, 4, 5])):
        assert kept.columns == d.columns
        got = kept.collect()
        assert all(tuple(r)[2:] == ("d", 1, 2, 3, "ab", "cd", 4, 5) for r in got)
        assert ids is None or sorted(r["doc_id"] for r in got) == ids
    got = idmaps.possible_rows(d, d.where("doc_id < 2").select("doc_id"))
    assert got.columns == d.columns and {0, 1} <= {r["doc_id"] for r in got.collect()}


# --- the pipeline


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in rows}
    assert kept < docs and len(kept) > 0.3 * len(docs)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
    held = Counter()
    for r in rows:
        held[r["doc_id"]] += r["length"]
    assert held == tokens


def test_stages_with_nulls_and_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"_rank": F.lit(1), "score": F.lit("x")})
    none = F.lit(None)
    odd = docs.limit(3).unionByName(docs.limit(2).withColumns({"doc_id": none.cast("long"), "lang": none.cast("string")})).unionByName(docs.limit(2).withColumn("text", none.cast("string")))
    for table in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns and out.count() <= table.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).select("doc_id").distinct().count() == table.select("doc_id").distinct().count()


def test_every_query_has_its_columns(spark):
    want = {
        "op1_toxicity": "doc_id held_out score predicted", "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op6_warc": "page_id payload_bytes payload_digest record_type refers_to", "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op8_license_scan": "doc_id n_blocks licenses findings", "op9_jaccard_join": "doc_id n_shingles component_id", "op10_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    found = __spark_entry__.queries()
    assert {"pipeline", "op2_token_counts", "op3_quote_threads", *want} <= found.keys()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for name, columns in want.items():
        df = found[name](spark, SF)
        assert set(columns.split()) <= set(df.columns), name
        if name not in ("op5_packing", "op6_warc"):
            assert Counter(r["doc_id"] for r in df.select("doc_id").collect()) == Counter(docs.keys()), name


def test_op5_by_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    windows, held = defaultdict(int), Counter()
    for r in queries.op5_packing(spark, SF).collect():
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) and len(part) == r["length"]
        windows[r["sequence_id"]] += r["length"]
        held[r["doc_id"]] += r["length"]
    assert held == {i: len(x) for i, x in ids.items()} and all(n == 2048 or n & (n - 1) == 0 for n in windows.values())
