"""The operators against brute force, exact round trips and held-out rows, with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, components, exact_dedup, hashing, jaccard, licenses, packing, quotes, rules, token_rollup, toxicity, warc
from graphloom.session import new_path

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "two words", "a b \x1c c", "x" * 3000, "the same text here again " * 40, "> #*$ %&|<>\n\n> #*$ %&|<>\n", "Ünï ÇÖDE 漢字 😀 and and"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, near and exact copies, repeated rows, and a column whose name clashes with the operators' own."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 300]))]
        texts.append(" ".join(base))
        for k in range(3):
            near = list(base)
            near[rng.randrange(len(near))] = f"n{k}"
            texts += [" ".join(near), " ".join(base).upper() if k == 0 else " ".join(base)]
    rows = [(i, t, "en", "src0" if i % 3 else None, len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:5], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


# --- word hashing


def test_words_are_those_of_the_pattern():
    texts = [t or "" for t in ODD]
    data, offsets = hashing.raw_text(pa.array(ODD))
    got = hashing.Words(data, offsets)
    for i, t in enumerate(texts):
        own = got.hashes[got.rows[i] : got.rows[i + 1]]
        assert len(own) == len(WORD.findall(t))
        assert len(set(own.tolist())) == len(set(WORD.findall(t)))


# --- 1


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = [rng.choice(plain) for _ in range(30)] + (["vile", "scum"] if bad else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t)))
        labels.append((i, 1 if bad else 0))
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(got[i]["predicted"] == y for i, y in labels if got[i]["held_out"])
    assert got[900]["score"] == got[901]["score"] < toxicity.THRESHOLD
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit_toxicity(docs, flipped)
    assert np.array_equal(model[0], again[0]) and np.allclose(model[1], again[1])
    assert toxicity.clean_documents(docs, model).count() == 452


def test_toxicity_scores_alike_at_any_size(spark):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(20)]

    def row(i):
        bad = rng.random() < 0.12
        # a word that half of its texts are toxic with
        t = [rng.choice(plain) for _ in range(6)] + ["hm"] * (rng.random() < (0.6 if bad else 0.08)) + ["vile"] * (bad and rng.random() < 0.5)
        rng.shuffle(t)
        return i, " ".join(t), int(bad)

    rows = spark.createDataFrame([row(i) for i in range(40_000)], "doc_id long, text string, toxic int").persist()
    odd = rows.where("doc_id % 20 = 0")
    few, many = (
        toxicity.toxicity_scores(odd, toxicity.fit_toxicity(part, part.select("doc_id", "toxic"))).agg(F.avg("score")).first()[0] for part in (rows.where("doc_id < 12000"), rows)
    )
    assert abs(few - many) < 0.04, (few, many)


def test_toxicity_sets_travel_in_small_pieces():
    rng = random.Random(8)
    texts = [None, "", "one", *(" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (3, 50, 2000, 90_000, 40, 3000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([i % 2 for i in range(len(texts))], pa.int32()), pa.array(texts)], ["key", "label", "text"])
    got = [r for part in toxicity._slot_sets(iter([batch])) for r in part.to_pylist()]
    assert max(len(r["slots"]) for r in got) <= toxicity.PIECE < len(got)
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        own = [r for r in got if r["key"] == i]
        assert [r["piece"] for r in own] == list(range(len(own))) and {r["label"] for r in own} == {i % 2}
        assert [x for r in own for x in r["slots"]] == np.unique(toxicity._features(data, np.array([0, len(data)]))[0]).tolist()
    # pieces may meet in any order and in any batches
    kind = pa.schema([("key", pa.int64()), ("label", pa.int32()), ("piece", pa.int32()), ("slots", pa.list_(pa.int32()))])
    learned = []
    for size in (len(got), 7):
        batches = [pa.RecordBatch.from_pylist(got[k : k + size], kind) for k in range(0, len(got), size)]
        learned.append(next(toxicity._trained(iter(batches), 2)).to_pydict())
        rng.shuffle(got)
    assert learned[0] == learned[1] and learned[0]["slot"]
    assert next(toxicity._trained(iter([]), 2)).num_rows == 0


def test_toxicity_without_labels(docs, none):
    marks = none.select("doc_id", F.lit(1).alias("toxic"))
    model = toxicity.fit_toxicity(docs, marks)
    assert {r["score"] for r in toxicity.toxicity_scores(docs, model).collect()} == {0.0}
    assert toxicity.toxicity_scores(none, model).count() == 0
    assert toxicity.clean_documents(docs, model).columns == docs.columns


# --- 2


def test_rollup_by_deltas(spark, docs):
    import tiktoken

    counts = token_rollup.token_counts(docs, RANKS, PATTERN, "v1").persist()
    enc = packing.tokenizer(RANKS, PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    assert {(r["doc_id"], r["n_tokens"]) for r in counts.collect()} == {(i, len(enc.encode_ordinary(t))) for i, t in texts_of(docs)}
    store = token_rollup.TokenRollup(spark, new_path(spark, "rollup"))
    assert store.totals().count() == 0
    gone = counts.where("doc_id % 2 = 0")
    revised = counts.where("doc_id % 2 = 1").withColumn("n_tokens", F.col("n_tokens") + 7)
    assert store.commit("a", token_rollup.inserts(counts))
    assert store.commit("b", token_rollup.deletes(gone))
    for k in range(2):
        assert store.commit("c", token_rollup.revisions(counts.where("doc_id % 2 = 1"), revised)) == (k == 0)
    want = Counter()
    for r in revised.collect():
        want[r["source"], "n"] += 1
        want[r["source"], "t"] += r["n_tokens"]
    for _ in range(3):
        totals = store.totals()
        assert {r["source"]: (r["n_docs"], r["n_tokens"]) for r in totals.collect()} == {s: (want[s, "n"], want[s, "t"]) for s in {k[0] for k in want}}
        store.fold()
    store.commit("d", token_rollup.deletes(revised))
    assert store.totals().count() == 0


# --- 3


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "On Monday X wrote:\n> Hello there\n>  how ARE you?\nFine thanks"), (1, 2, "user", "> > Hello there\n> Fine thanks\nGood!"),
        (1, 3, "assistant", "> good!\nBye"), (1, 4, "user", "> never said\nunrelated"), (2, 0, "user", None), (None, 1, "user", "> Hello there"), (3, 0, "u", "ok"), (3, 1, "u", "ok"), (3, 2, "u", "> ok\nyes"), (3, 2, "u", "> ok\nno"),
    ]
    m = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, level int")
    got = {(r["conv_id"], r["turn"], r["text"]): (r["parent_turn"], r["root_turn"], r["depth"]) for r in quotes.conversations(m.drop("level")).collect()}
    assert got == {
        (1, 0, "Hello there\nHow are you?"): (None, 0, 0), (1, 1, "Fine thanks"): (0, 0, 1), (1, 2, "Good!"): (1, 0, 2), (1, 3, "Bye"): (2, 0, 3), (1, 4, "unrelated"): (None, 4, 0),
        (2, 0, ""): (None, 0, 0), (None, 1, ""): (None, 1, 0), (3, 0, "ok"): (None, 0, 0), (3, 1, "ok"): (None, 1, 0), (3, 2, "yes"): (1, 1, 1), (3, 2, "no"): (1, 1, 1),
    }
    assert quotes.reply_threads(m.limit(0)).count() == 0


def test_long_reply_chain(spark):
    m = spark.createDataFrame([(1, i, "u", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(40)], "conv_id long, turn long, role string, text string")
    assert {(r["turn"], r["root_turn"], r["depth"]) for r in quotes.reply_threads(m).collect()} == {(i, 0, i) for i in range(40)}


# --- 4


def test_misra_gries_bound():
    keys = [b"a"] * 40 + [bytes([i]) for i in range(60)]
    random.Random(3).shuffle(keys)
    held = exact_dedup.misra_gries(iter(keys), 4)
    assert len(held) <= 4 and 40 - 100 / 5 <= held[b"a"] <= 40


@pytest.mark.parametrize("share", [2, 8, 512])
def test_copies(docs, none, share):
    by = defaultdict(list)
    for i, t in texts_of(docs):
        by[t].append(i)
    got = exact_dedup.copy_groups(docs, share).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == Counter((i, max(by[t]), len(by[t]), i == max(by[t]), hashlib.sha256(t.encode()).hexdigest()) for t in by for i in by[t])
    kept = exact_dedup.distinct_documents(docs, share)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(v) for v in by.values()) and kept.columns == docs.columns
    assert exact_dedup.copy_groups(none).count() == 0 and exact_dedup.distinct_documents(none).count() == 0


def test_copies_without_ids(spark):
    d = spark.createDataFrame([(None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.copy_groups(d).collect()} == {(None, 1, False), (1, 1, True), (None, None, True)}


# --- 5


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in texts_of(docs)}
    for size in (16, 2048):
        rows = packing.pack_documents(docs.dropDuplicates(["doc_id"]), RANKS, PATTERN, size).collect()
        at, windows = defaultdict(list), defaultdict(list)
        for r in rows:
            at[r["doc_id"]].append(r)
            windows[r["sequence_id"]].append(r)
        import zlib

        for i, ids in want.items():
            pos = 0
            for r in sorted(at[i], key=lambda r: r["start"]):
                part = np.array(ids[pos : pos + r["length"]], "<u4")
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (pos, len(ids), zlib.crc32(part.tobytes()))
                pos += r["length"]
            assert pos == len(ids)
        for pieces in windows.values():
            pos = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == pos
                pos += r["length"]
            assert pos == size or pos & (pos - 1) == 0
    assert packing.pack_documents(none, RANKS, PATTERN).count() == 0


def test_packing_of_added_tokens(spark):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x  {end}\n\n {end} y", f"<|endoftext {end[:-1]} it's", f"{end[:5]}{end}'s"]
    texts += ["".join(rng.choice(["a", " ", "  ", "\n", "é", "12", "'s", end, "<|", "|>", "漢"]) for _ in range(20)) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = defaultdict(list)
    for r in packing.pack_documents(d, RANKS, PATTERN, 16).collect():
        at[r["doc_id"]].append(r)
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for i, x in enumerate(texts):
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        for r in at[i]:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(part.tobytes())), x
        assert sum(r["length"] for r in at[i]) == len(ids)


def test_placement_is_the_best_by_squares():
    rng = random.Random(2)
    w = packing.SquareSums(20)
    for k in range(300):
        n = rng.randrange(1, 20)
        before, options = w.counts.copy(), []
        for level in range(0, 21 - n):
            if level and not before[level]:
                continue
            c = before.copy()
            c[level] -= level > 0
            c[level + n] += level + n < 20
            options.append(int((c[1:20] ** 2).sum()))
        w.add(k, np.zeros(n, np.uint32))
        assert int((w.counts[1:20] ** 2).sum()) == min(options)


# --- 6


def test_archives(spark):
    pages = [(1, "u", "x" * 70_000, 0), (2, None, "x" * 70_000, 0), (3, "a\nb", "é" * 200_000 + "\r\n\r\nWARC/1.1", 0), (4, "z", None, 0), (5, "z", "", 0), (None, "q", "<p>", 0), (4, "z", None, 0), (6, "s", "ab", 0), (7, "s", "ab", 0)]
    p = spark.createDataFrame(pages, "page_id long, url string, html string, chunk int")
    for least in (0, 3):
        by = defaultdict(list)
        for i, _, h, _ in pages:
            by[h or ""].append(i)
        want = Counter()
        for i, _, h, _ in pages:
            raw = (h or "").encode()
            top = max((x for x in by[h or ""] if x is not None), default=None)
            first = len(raw) < least or i == top
            want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else top] += 1
        path = new_path(spark, "warc")
        warc.write_archives(p, path, least)
        rows = warc.read_archives(spark, path).collect()
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
        assert all(r["intact"] for r in rows)
    path = new_path(spark, "warc")
    warc.write_archives(p.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


# --- 7


def brute_counts(t):
    w = WORD.findall(t)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_counts(docs, none):
    want = {i: brute_counts(t) for i, t in texts_of(docs)}
    for r in rules.judged(docs, []).collect():
        assert tuple(r[c] for c in rules.BASE) == want[r["doc_id"]]
        n, rep = want[r["doc_id"]][0], want[r["doc_id"]][4]
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n) and r["kept"] == (not r["base_failed"])
    assert rules.judged(none, []).count() == 0 and rules.passing(none, []).columns == none.columns
    kept = {r["doc_id"] for r in rules.judged(docs, []).where("kept").collect()}
    assert {r["doc_id"] for r in rules.passing(docs, []).collect()} == kept


def test_rules_find_the_concept():
    rng = np.random.default_rng(1)
    x = {k: rng.random(3000) for k in ("symbol_share", "upper_share", "digit_share")}
    y = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.6) & (x["digit_share"] <= 0.3))
    found = rules.learn_rules(x, y)
    hit = np.zeros(3000, bool)
    for r in found:
        hit |= rules._covered(r, x, 3000)
    assert (hit == y).mean() > 0.97


def test_rules_fit_and_apply(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rules.judged(docs, rules.fit_rules(docs, labels)).join(labels, "doc_id").where("not base_failed")
    assert got.where("quality = 1 and not kept").count() == 0 and got.where("quality = 0 and kept").count() <= 2
    assert rules.fit_rules(docs, labels.limit(0)) == []


# --- 8


def test_licenses(spark, none):
    long = "word " * 30_000
    rows = [(1, "intro\nReleased under the MIT License.\nend"), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY 4.0"), (4, "the license of my car"), (5, None), (6, ""), (7, long + "\nThis work is licensed under the GNU General Public License, version 3.\n" + long), (8, "This work is licensed under the GNU General Public License, version 2.")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_findings(d).collect()}
    assert got == {1: ["MIT"], 2: ["CC-BY-NC-4.0"], 3: ["CC-BY-4.0"], 4: [], 5: [], 6: [], 7: ["GPL-3.0"], 8: ["GPL-2.0"]}
    assert licenses.license_findings(none).count() == 0


def test_every_template_finds_itself():
    for name, body in licenses.TEMPLATES.items():
        assert name in [f[0] for f in licenses.scan(f"first line\n{body}\nlast line")[1]]
    assert licenses.wording(["a", "b", "c"], ["x", "a", "q", "c"]) == (1, 1)


def names(text):
    return [f[0] for f in licenses.scan(text)[1]]


def test_notices_anywhere_in_a_line():
    far = "our license page " + "word " * 2000
    assert names(far + "Released under the MIT License. " + far + "Licensed under CC BY-SA 4.0. " + far) == ["CC-BY-SA-4.0", "MIT"]
    six = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "GPL-3.0", "MPL-2.0"]
    assert names(" ".join(licenses.TEMPLATES[n] for n in six)) == sorted(six)
    every = " ".join(licenses.TEMPLATES.values())
    assert names(every) == sorted(licenses.TEMPLATES)
    assert names("." * 50_000 + " license " + "-" * 50_000) == []


def test_wrapped_and_differing_notices(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    assert names(mpl) == ["MPL-2.0"]
    assert names("intro\n// Released under the MIT\n// License.") == ["MIT"]
    assert names("Dedicated to the public\n * domain under CC0 1.0.") == ["CC0-1.0"]
    for text, lacking, added in [("Released under a MIT License", 1, 1), ("Released under MIT License", 1, 0), ("Released under the nice MIT License", 0, 1)]:
        assert [(f[0], f[3], f[4]) for f in licenses.scan(text)[1]] == [("MIT", lacking, added)]
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert names("This work is licensed under the GNU General Public License, version 2.0") == ["GPL-2.0"]
    for other in ("Licensed under CC BY-NC-SA 4.0, a license", "Licensed under CC BY 3.0, a license", "Released under the license", "Licensed under the BSD 4-Clause License."):
        assert names(other) == []
    d = spark.createDataFrame([(1, mpl), (2, "Dedicated to the public\n * domain under CC0 1.0.")], "doc_id long, text string")
    assert [(r["licenses"], r["findings"][0]["lacking"]) for r in licenses.license_findings(d).orderBy("doc_id").collect()] == [(["MPL-2.0"], 0), (["CC0-1.0"], 0)]


def test_license_query_returns_differences(spark):
    from graphloom.llm import queries

    assert "findings" in queries.op8_license_scan(spark, SF).columns


# --- 9


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t.translate({k: k + 32 for k in range(65, 91)}))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    to = {i: i for i in sets}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                to[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 4, 5)])
def test_similar_documents(docs, none, n, num, den):
    want = brute_components(texts_of(docs), n, num, den)
    rows = jaccard.similar_documents(docs, n, num, den).collect()
    assert len(rows) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert jaccard.similar_documents(none, n, num, den).count() == 0


def stock_of_sentences(spark, rows):
    """Texts of half of sixty sentences each, in order: half of the prefixes of any two agree, and no two are similar."""
    rng = random.Random(3)
    stock = [" ".join(rng.choice(["".join(rng.choices("abcdefgh", k=4)) for _ in range(1)]) for _ in range(rng.randint(8, 12))) for _ in range(60)]
    return spark.createDataFrame([(i, ". ".join(stock[k] for k in sorted(rng.sample(range(60), 30)))) for i in range(rows)], "doc_id long, text string")


def test_common_stock_and_its_copies(spark):
    docs = stock_of_sentences(spark, 120)
    near = docs.where("doc_id % 3 = 0").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" and one more line here")).alias("text"))
    both = docs.unionByName(near)
    want = brute_components(texts_of(both), 5, 4, 5)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(both).collect()} == want
    assert sum(i != c for i, (_, c) in want.items()) == 40


def test_one_of_each(docs):
    want = brute_components(texts_of(docs), 5, 4, 5)
    kept = jaccard.one_of_each(docs)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c} and kept.columns == docs.columns


def test_sketches_never_lose_a_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    for n, m in ((5000, 4700), (600, 560), (64, 60)):
        a, b = jaccard._wide(base[:n]), jaccard._wide(base[n - m : n])
        words = min(len(a), len(b))
        fold = lambda w: np.bitwise_xor.reduce(w.reshape(-1, words), axis=0)
        assert sum(int(x).bit_count() for x in (fold(a) ^ fold(b)).view(np.uint64).tolist()) <= n - m
        d = spark.createDataFrame([(a.tolist(), words)], "w array<long>, n int")
        assert d.select(jaccard._folded(F.col("w"), F.col("n"))).first()[0] == fold(a).tolist()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 80), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(51)} | {80: 80, 90: 80}


# --- 10


def test_bpe_equals_the_library(docs, none):
    enc = packing.tokenizer(RANKS, PATTERN)
    rows = {r["doc_id"]: r for r in bpe.round_trip_digests(docs, RANKS, PATTERN).collect()}
    for i, t in texts_of(docs):
        ids = enc.encode_ordinary(t)
        r = rows[i]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    encoded = bpe.encode_documents(docs, RANKS, PATTERN)
    assert {(r["doc_id"], bytes(r["decoded"]).decode()) for r in bpe.decode_documents(encoded, RANKS, PATTERN).collect()} == set(texts_of(docs))
    assert bpe.round_trip_digests(none, RANKS, PATTERN).count() == 0


def test_bpe_on_random_and_long_pieces():
    rng = random.Random(9)
    texts = ["".join(rng.choice("aabé漢 \n!1😀") for _ in range(rng.choice([1, 7, 60, 900]))) for _ in range(150)] + ["a" * 20_000, " " * 3000]
    enc = packing.tokenizer(RANKS, PATTERN)
    assert list(bpe.codec(RANKS, PATTERN).encode_batch(texts)) == [enc.encode_ordinary(t) for t in texts]


# --- the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF).persist()
        assert after.columns == docs.columns, name
        assert after.join(at, docs.columns, "left_anti").count() == 0
        at = after
    assert at.count() == at.select("text").distinct().count()
    want = brute_components(texts_of(at), 5, 4, 5)
    assert all(i == c for i, (_, c) in want.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert packed.select("doc_id").distinct().count() == at.count()


def test_very_long_texts(spark):
    rng = random.Random(31)
    words = [f"w{rng.randrange(50_000)}" for _ in range(200_000)]
    long = " ".join(words)
    texts = {1: long, 2: long, 3: long[:-1] + "#", 4: "short text of six words only", 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in exact_dedup.copy_groups(docs).collect()}
    assert {k: r["keep_id"] for k, r in got.items()} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5} and all(r["text_sha256"] == hashlib.sha256(texts[k].encode()).hexdigest() for k, r in got.items())
    pieces = packing.pack_documents(docs, RANKS, PATTERN).collect()
    lengths = {k: len(packing.tokenizer(RANKS, PATTERN).encode_ordinary(t)) + 1 for k, t in texts.items()}
    assert {k: sum(r["length"] for r in pieces if r["doc_id"] == k) for k in texts} == lengths
    shingles = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}
    linked = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs).collect()}
    assert linked[1] == linked[2] == (len(shingles), 1) and linked[3][1] == 1 and linked[4] == (2, 4) and linked[5] == (0, 5)
    counted = {r["doc_id"]: r for r in rules.judged(docs, []).collect()}
    assert (counted[1]["n_words"], counted[1]["word_chars"]) == (200_000, sum(map(len, words))) and counted[3]["n_symbols"] == 1
