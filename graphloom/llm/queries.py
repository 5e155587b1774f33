"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, written
from . import bpe, divergence, exact_dedup, idmaps, jaccard, licenses, packing, quotes, recompression, rules, secrets, token_rollup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and version of the tokenizer after three batches, one of them delivered twice: all
    documents come, counted by two vocabularies; those labelled toxic go; those labelled of low quality are counted anew
    without repeated lines. Totals are folded before the last batch, so what comes out is that table and one batch."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    counts = written(_counts(docs), "token-counts")
    store = token_rollup.TokenRollup(spark, new_path(spark, "token-rollup"))
    store.commit("inserts", token_rollup.inserts(counts))
    gone = labels.where("toxic = 1").select("doc_id").distinct()
    store.commit("deletes", token_rollup.deletes(counts.join(gone, "doc_id", "left_semi")))
    store.fold()
    revised = labels.where("quality = 0 and toxic = 0").select("doc_id").distinct()
    some = idmaps.possible_rows(docs.select("doc_id", "source", "lang", "text"), revised)
    lines = some.join(revised, "doc_id", "left_semi").withColumn("text", F.array_join(F.array_distinct(F.split("text", "\n")), "\n"))
    new = written(_counts(lines), "token-counts")
    deltas = token_rollup.revisions(counts.join(revised, "doc_id", "left_semi"), new)
    for _ in range(2):
        store.commit("revisions", deltas)
    return store.totals()


def _counts(docs: DataFrame) -> DataFrame:
    """Token counts by both byte-level vocabularies, the versions of the tokenizer."""
    import public_tokenizers

    versions = ("byte_bpe_50k", "byte_bpe_multi_50k")
    a, b = (token_rollup.token_counts(docs, public_tokenizers.path(f"{v}.tiktoken"), public_tokenizers.PATTERN, version=v) for v in versions)
    return a.unionByName(b)


def _replies(messages: DataFrame) -> DataFrame:
    """Who replies to whom: each message to the one before it, every fourth to the one before that."""
    parent = F.col("turn") - F.when(F.col("turn") % 4 == 3, 2).otherwise(1)
    return messages.where("turn > 0").select("conv_id", "turn", parent.alias("parent_turn")).distinct()


def op3_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations written as mail that quotes what it replies to and what that replies to, then put together
    again: every message without quotes, with what it replies to."""
    messages = _table(spark, sf_dir, "conversations")
    return quotes.conversations(quotes.as_mail(messages, _replies(messages)))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document's text."""
    return exact_dedup.copy_groups(_table(spark, sf_dir, "documents"))


def _ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), *_ranks())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    pages, path = _table(spark, sf_dir, "pages"), new_path(spark, "warc")
    warc.write_archives(pages, path)
    return warc.read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = _table(spark, sf_dir, "documents")
    return rules.judged(docs, rules.fit_rules(docs, _table(spark, sf_dir, "labels")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document, with offsets, bytes saved and wording differences."""
    return licenses.license_findings(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by three-word shingles at a similarity of 0.9."""
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), *_ranks())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others and against the language."""
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of what the patterns find, and all spans."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, secrets.KINDS))
    named = F.filter("spans", lambda s: s["kind"] < 3)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(named), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """The documents, words from place a on repeated with period p in every tenth by the checksum of doc_id; a and p are
    by that checksum and the number of words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    some = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("words").cast("long"), F.expr("h div 10")
    some = some.withColumns({"n": n, "g": g}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = "concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a)))"
    return some.select("doc_id", F.when(F.col("n") > 0, F.expr(f"array_join({again}, ' ')")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document."""
    found = recompression.periodic_runs(_with_periods(_table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumns({"best": best, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    return found.selectExpr(
        "doc_id", "bigint(size(runs)) AS n_runs", "best.start", "-best.minus AS length", "best.period", "-1000 * best.minus div best.period AS exponent_milli",
        "sha2(lines, 256) AS runs_sha256", "sha2(collapsed, 256) AS collapsed_sha256",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    found = [op1_toxicity, op2_token_counts, op3_quote_threads, op4_exact_dedup, op5_packing, op6_warc, op7_quality_rules, op8_license_scan, op9_jaccard_join, op10_byte_bpe, op11_source_divergence, op12_secret_scan, op13_periodic_runs]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query."""
    return {
        "op3_quote_threads": r"""
            WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
            u AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform(list_concat([text], string_split(regexp_replace(text, '([.!?]+)[ \t\r\n]+', '\1' || chr(31), 'g'), chr(31)), string_split(text, chr(10))),
                     lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x <> '')) AS keys,
                   trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS whole FROM m),
            held AS (SELECT DISTINCT conv_id, turn, unnest(keys) AS key FROM u),
            r AS (SELECT DISTINCT conv_id, turn, turn - CASE WHEN turn % 4 = 3 THEN 2 ELSE 1 END AS p_turn FROM conversations WHERE turn > 0),
            q AS (SELECT r.conv_id, r.turn, 1 AS level, u.whole FROM r JOIN u ON u.conv_id = r.conv_id AND u.turn = r.p_turn
                  UNION ALL SELECT r.conv_id, r.turn, 2, u.whole FROM r JOIN r g ON g.conv_id = r.conv_id AND g.turn = r.p_turn JOIN u ON u.conv_id = g.conv_id AND u.turn = g.p_turn
                            WHERE EXISTS (SELECT 1 FROM m WHERE m.conv_id = r.conv_id AND m.turn = r.p_turn)),
            l AS (SELECT q.conv_id, q.turn, q.level, max(held.turn) AS holder FROM q JOIN held ON held.conv_id = q.conv_id AND held.key = q.whole AND held.turn < q.turn GROUP BY 1, 2, 3),
            p AS (SELECT conv_id, turn, arg_min(holder, level) AS parent_turn, count(*) AS n_links FROM l GROUP BY 1, 2),
            walk AS (SELECT conv_id, turn, parent_turn AS root_turn, 1::BIGINT AS depth FROM p
                     UNION ALL SELECT w.conv_id, w.turn, p.parent_turn, w.depth + 1 FROM walk w JOIN p ON p.conv_id = w.conv_id AND p.turn = w.root_turn),
            top AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(root_turn, depth) AS root_turn FROM walk GROUP BY 1, 2)
            SELECT m.conv_id, m.turn, m.role, m.text, p.parent_turn, coalesce(top.root_turn, m.turn) AS root_turn, coalesce(top.depth, 0) AS depth, coalesce(p.n_links, 0) AS n_links
            FROM m LEFT JOIN p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn""",
        "op4_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op6_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
            m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
            SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
                   list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
                   CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> top THEN top END AS refers_to, true AS intact
            FROM m""",
        "op11_source_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
            w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{80}-\x{10FFFF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
            l AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
            c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN l ON l.lang = w.lang AND l.term = w.term GROUP BY 1, 2, 3),
            g AS (SELECT DISTINCT lang, source FROM d),
            every AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, l.n AS lang_n FROM g JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
            weighed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source) AS a, sum(lang_n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source) AS b FROM every),
            p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 5)) // a)::BIGINT AS p, (1 + (1000000000::HUGEINT * (lang_n + 5)) // b)::BIGINT AS q FROM weighed),
            sums AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3),
            pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source
                      LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
            found AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
            QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50""",
    }
