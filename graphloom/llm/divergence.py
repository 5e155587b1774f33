"""Source divergence audit: how far the terms of each source of a language lie from other sources, and from the language.

Terms are counted in tasks and summed up by Spark. A group is a source in a language. What a term adds depends only on
its count in the group and its count in the language, so a group's terms fall into cells of these two counts, and
the measure is worked out once a cell. Cells of equal value are merged, ranked, and a running sum of how many terms
they hold tells which values the ranks asked for reach; only these cells are expanded to terms, in the order of UTF-8.

Sources of a language are compared term by term: the sources that have a term are brought together (at most ``TILE``
by ``TILE`` of them, so no list grows), and differences are summed in a table of sources by sources before anything is
moved. Terms that one or both of two sources lack are added from the cells.

All arithmetic is in whole numbers. Defined results: null text, lang and source are empty; a group without terms, or a
language without kept terms, still has its pairs; repeated rows count as often as they stand; doc_id and other columns
are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .hashing import give_back, raw_text, row_blocks
from .terms import NOT_LETTER, TextBlock

#: Bytes of text that are counted together, and sources on one side of a table of distances, about.
TOGETHER, TILE = 1 << 21, 64
#: Lists of sources that are compared together.
LISTS = 2048
#: Added to every count; shares are whole billionths.
ADDED, SCALE = 5, 1_000_000_000


def _group_counts(block: TextBlock, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Group, code, occurrences and documents of each term of each group; and the terms by code."""
    codes, words = block.codes(lower=True)
    size = max(1, len(words))
    held, many = np.unique(block.row_of_words() * size + codes, return_counts=True)
    keys, at = np.unique(group[held // size] * size + held % size, return_inverse=True)
    return keys // size, keys % size, np.bincount(at, many, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys)), words


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it): parts that still have to be summed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (pc.fill_null(column, "").dictionary_encode() for column in batch.columns[:2])
            width = max(1, len(source.dictionary))
            group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
            data, offsets = raw_text(batch.column(2))
            for a, b in row_blocks(offsets, TOGETHER):
                own, codes, n, docs, words = _group_counts(TextBlock(data, offsets[a : b + 1], NOT_LETTER), group[a:b])
                columns = [lang.dictionary.take(pa.array(own // width)), source.dictionary.take(pa.array(own % width)), words.take(pa.array(codes)).cast(pa.string()), pa.array(n), pa.array(docs.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        give_back()

    return docs.select("lang", "source", "text").mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def _share(n: Column, weight: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / weight), also where the product is beyond 64 bits."""
    return F.call_function("div", (n + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), weight.cast("decimal(20,0)")) + 1


def _table(rows: pa.Array, one_tile: bool) -> tuple[pa.Array, np.ndarray]:
    """Sources of the lists ``rows``, and a table of sources by sources, summed over lists: how far apart shares are,
    less what that would be if one or both had none. Nothing is added where one has none. Unless the table is that of
    one tile, pairs of a tile are left to theirs."""
    flat = rows.flatten()
    sources = flat.field(0).dictionary_encode()
    who, none, tile = sources.indices.to_numpy(), np.zeros(len(sources.dictionary), np.int64), np.zeros(len(sources.dictionary), np.int64)
    none[who], tile[who] = flat.field(2).to_numpy(), flat.field(3).to_numpy()
    shares = np.repeat(none[:, None], len(rows), 1)
    shares[who, np.repeat(np.arange(len(rows)), pc.list_value_length(rows).to_numpy())] = flat.field(1).to_numpy()
    out = np.abs(none[:, None] - none) * len(rows)
    for i in range(len(none)):
        out[i] += (np.abs(shares[i] - shares) - np.abs(shares[i] - none[:, None]) - np.abs(none[i] - shares)).sum(1)
    if not one_tile:
        out[tile[:, None] == tile] = 0
    return sources.dictionary, np.triu(out, 1)


def _distances(posts: DataFrame) -> DataFrame:
    """lang, a, b (a < b) and d: over the terms that both sources have, how far apart their shares are, less what that
    would be if one or both had none. ``posts``: lang, source, term, p (the share), none (that of a term it lacks), tiles
    (of the language)."""
    own = posts.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    # a row goes wherever its tile meets one, itself included
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda k: F.struct(F.least("tile", k).alias("x"), F.greatest("tile", k).alias("y")))
    own = own.select("lang", "term", F.explode(meet).alias("at"), F.struct("source", "p", "none", "tile").alias("row"))
    lists = own.groupBy("lang", "term", "at").agg(F.collect_list("row").alias("rows")).where("size(rows) > 1")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, LISTS):
                part = batch.slice(first, LISTS)
                lang, at = (column.dictionary_encode() for column in part.columns[:2])
                tables = lang.indices.to_numpy().astype(np.int64) * len(at.dictionary) + at.indices.to_numpy()
                for k in np.unique(tables):
                    x, y = at.dictionary[int(k) % len(at.dictionary)].as_py().split()
                    names, out = _table(part.column(2).filter(pa.array(tables == k)), x == y)
                    a, b = np.nonzero(out)
                    langs = lang.dictionary.take(pa.array(np.full(len(a), int(k) // len(at.dictionary))))
                    yield pa.RecordBatch.from_arrays([langs, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(out[a, b])], ["lang", "a", "b", "d"])

    found = lists.select("lang", F.concat_ws(" ", "at.x", "at.y").alias("at"), "rows").mapInArrow(summed, "lang string, a string, b string, d long")
    return found.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("d").alias("d"))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of every group.

    Terms are runs of letters and characters beyond ASCII, A to Z lower-cased; a language keeps those that at least
    ``min_docs`` of its documents have. A share of a kept term is 1 + floor(SCALE * (n + ADDED) / (N + ADDED * V)), N
    being the sum of n over the V kept terms. Part ``pair`` ranks the other sources of the language by the sum of the
    differences of shares over all kept terms; part ``term`` ranks the ``top`` terms of the group whose share is above
    the language's by that difference. Ties are ranked by item.
    """
    named = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    counts = written(term_counts(named).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    posts = written(counts.drop("docs").join(kept, ["lang", "term"]), "posts")
    cells = written(posts.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("many")), "cells")

    langs = cells.groupBy("lang").agg(F.sum(F.col("n") * F.col("many")).alias("lang_sum"))
    langs = langs.join(posts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang")
    sums = cells.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("many")).alias("sum"), F.sum("many").alias("own_terms"))
    groups = written(named.select("lang", "source").distinct(), "sources")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    groups = groups.join(tiles, "lang").join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0)
    groups = groups.withColumns({"weight": F.col("sum") + ADDED * F.col("terms"), "lang_weight": F.col("lang_sum") + ADDED * F.col("terms")})
    groups = written(groups.withColumn("none", F.when(F.col("weight") > 0, _share(F.lit(0), F.col("weight"))).otherwise(0)), "groups")

    # terms: cells of equal value are merged, and expanded as far as the ranks go
    valued = cells.join(groups.select("lang", "source", "weight", "lang_weight"), ["lang", "source"])
    valued = valued.withColumn("value", _share(F.col("n"), F.col("weight")) - _share(F.col("lang_n"), F.col("lang_weight"))).where("value > 0")
    falling = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    values = valued.groupBy("lang", "source", "value").agg(F.sum("many").alias("many")).withColumn("at", F.row_number().over(falling)).where(F.col("at") <= top)
    values = values.withColumn("before", F.sum("many").over(falling) - F.col("many")).where(F.col("before") < top).select("lang", "source", "value")
    reached = valued.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value")
    terms = posts.join(reached, ["lang", "source", "n", "lang_n"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # pairs: what one source has and the other lacks, from cells; what both have, term by term; what neither has
    shares = posts.join(groups.select("lang", "source", "weight", "none", "tiles"), ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("weight")).alias("p"), "none", "tiles")
    x, y = (groups.select("lang", *(F.col(c).alias(f"{side}_{c}") for c in ("source", "own_terms", "none", "terms"))) for side in "xy")
    both = x.join(y, "lang").where("x_source <> y_source")
    own = cells.groupBy("lang", "source", "n").agg(F.sum("many").alias("many")).join(groups.select("lang", "source", "weight"), ["lang", "source"])
    own = own.select("lang", F.col("source").alias("x_source"), _share(F.col("n"), F.col("weight")).alias("p"), "many")
    others = groups.select("lang", F.col("source").alias("y_source"), F.col("none").alias("y_none"))
    lacks = own.join(others, "lang").where("x_source <> y_source").groupBy("lang", "x_source", "y_source").agg(F.sum(F.abs(F.col("p") - F.col("y_none")) * F.col("many")).alias("d"))
    apart = _distances(shares)
    parts = [both.select("lang", "x_source", "y_source", ((F.col("x_terms") - F.col("x_own_terms") - F.col("y_own_terms")) * F.abs(F.col("x_none") - F.col("y_none"))).alias("d")), lacks, lacks.select("lang", F.col("y_source").alias("x_source"), F.col("x_source").alias("y_source"), "d")]
    parts += [apart.select("lang", F.col(a).alias("x_source"), F.col(b).alias("y_source"), "d") for a, b in ("ab", "ba")]
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs.groupBy("lang", F.col("x_source").alias("source"), F.lit("pair").alias("part"), F.col("y_source").alias("item")).agg(F.sum("d").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)
