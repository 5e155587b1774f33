"""Quotation linking in conversations, with DataFrame functions only.

Lines beginning with ``>`` are quoted, as many levels deep as they have such marks; neighbouring lines of one level are
a passage. A passage is normalised to its words, so that marks, punctuation, case and line ends don't matter, and
hashed: as a whole, and for passages that quote a part of a message, by its sentences and lines. Messages hold the
hashes of their own text in the same way. A hash links to the latest earlier message of its conversation that holds it;
a passage to the message that holds it whole, else to the one that holds most of its hashes, the later of equals. A
message replies to what its shallowest linked passage quotes. Messages without links begin threads.

The latest earlier holder is found by a running maximum in blocks of BLOCK turns, then of blocks, then of blocks of
blocks, so no window holds all the messages that share a hash, and nothing joins all repeats of a text.

Defined results: null texts are empty; passages without a letter or digit link nothing; lines ``On ... wrote:`` before a
deeper quotation are taken out with it; messages of equal (conv_id, turn) tie: they hold each other's hashes but never
link to each other, and each is a row of the result; rows without conv_id or turn are threads of their own and hold
nothing. Turns are whole numbers. Empty tables give empty results; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

MARKS = r"^((?:[ \t]*>)+)"
WROTE = r"^[ \t]*On .*wrote:[ \t]*$"
#: Turns in a block, blocks in a block of blocks.
BLOCK = 1024


def line_level(line: Column) -> Column:
    """Depth of quotation."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    """The words in lower case; null if there is none."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def hashes(text: Column) -> Column:
    """Distinct hashes of a passage: the first is that of the whole, then those of its sentences and lines."""
    sentences = F.split(F.regexp_replace(text, r"([.!?]+)[ \t\r\n]+", "$1\u001f"), "\u001f")
    parts = F.concat(F.array(text), sentences, F.split(text, "\n"))
    return F.array_distinct(F.transform(F.filter(F.transform(parts, normalised), lambda x: x.isNotNull()), lambda x: F.xxhash64(x)))


def message_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, the ``text`` without quotes, and ``passages`` as an array of (at, level, text)."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = messages.select("conv_id", "turn", "role", F.transform(lines, lambda x: F.struct(line_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line"), x.alias("raw"))).alias("_all"))
    kept = F.transform("_all", lambda x, i: F.struct(i.alias("at"), x["level"].alias("level"), x["line"].alias("line"), (x["line"].rlike(WROTE) & (F.coalesce(F.get("_all", i + 1)["level"], F.lit(0)) > x["level"])).alias("out"), x["raw"].alias("raw")))
    rows = rows.withColumn("_all", kept)
    own = F.filter("_all", lambda x: (x["level"] == 0) & ~x["out"])
    quoted = F.filter("_all", lambda x: (x["level"] > 0) & ~x["out"])
    rows = rows.withColumns({"text": F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), "_quoted": quoted})
    # a passage begins where the level changes, or lines are left out
    starts = F.filter(F.transform("_quoted", lambda x, i: F.when((i == 0) | (x["level"] != F.get("_quoted", i - 1)["level"]) | (x["at"] != F.get("_quoted", i - 1)["at"] + 1), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_starts", starts)
    passages = F.transform("_starts", lambda s, k: F.struct(
        F.get("_quoted", s)["at"].alias("at"), F.get("_quoted", s)["level"].alias("level"),
        F.array_join(F.transform(F.slice("_quoted", s + 1, F.coalesce(F.get("_starts", k + 1), F.size("_quoted")) - s), lambda x: x["line"]), "\n").alias("text"),
    ))
    return rows.select("conv_id", "turn", "role", "text", passages.alias("passages"))


def latest_holders(held: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, key, turn, holder: for everything asked for (conv_id, key, turn) the latest earlier turn that holds it."""
    yes, no = F.lit(True), F.lit(False)
    rows = held.select("conv_id", "key", "turn", yes.alias("holds"), no.alias("asks")).unionByName(asked.select("conv_id", "key", "turn", no.alias("holds"), yes.alias("asks")))
    rows = rows.groupBy("conv_id", "key", "turn").agg(F.max("holds").alias("holds"), F.max("asks").alias("asks"))
    rows = rows.withColumns({"holder": F.when(F.col("holds"), F.col("turn").cast("long")), "at": F.col("turn").cast("long")})

    def in_blocks(rows: DataFrame, block: Column) -> DataFrame:
        before = Window.partitionBy("conv_id", "key", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("block", block).withColumn("before", F.max("holder").over(before))

    near = written(in_blocks(rows, F.floor(F.col("at") / BLOCK)), "holders")
    found = near.where("asks and before is not null").select("conv_id", "key", "turn", "before")
    # only what its own block doesn't answer goes on to blocks, and blocks of blocks
    left = near.where("asks and before is null").select("conv_id", "key", "turn", "block")
    up = near.join(left.select("conv_id", "key").distinct(), ["conv_id", "key"], "left_semi")
    for block in (F.floor(F.col("at") / BLOCK), F.lit(0).cast("long")):
        up = in_blocks(up.groupBy("conv_id", "key", F.col("block").alias("at")).agg(F.max("holder").alias("holder")), block)
        met = left.join(up.select("conv_id", "key", F.col("at").alias("block"), F.col("block").alias("next"), "before"), ["conv_id", "key", "block"])
        found = found.unionByName(met.where("before is not null").select("conv_id", "key", "turn", "before"))
        left = met.where("before is null").select("conv_id", "key", "turn", F.col("next").alias("block"))
    return found.withColumnRenamed("before", "holder")


def quote_links(passages: DataFrame) -> DataFrame:
    """One row per linked passage: conv_id, turn, at (its first line), level, n_hashes, n_linked, quoted_turn."""
    rows = passages.where("conv_id is not null and turn is not null")
    held = rows.select("conv_id", "turn", F.explode(hashes(F.col("text"))).alias("key"))
    asked = rows.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.at", "p.level", F.posexplode(hashes(F.col("p.text"))).alias("part", "key"))
    asked = written(asked, "quoted-hashes")
    found = asked.join(latest_holders(held, asked), ["conv_id", "key", "turn"], "left")
    votes = found.groupBy("conv_id", "turn", "at", "level", "holder").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("part") == 0).alias("whole"))
    best = votes.groupBy("conv_id", "turn", "at", "level").agg(F.sum("n").alias("n_hashes"), F.max(F.when(F.col("holder").isNotNull(), F.struct("whole", "n", "holder"))).alias("best"))
    return best.where("best is not null").select("conv_id", "turn", "at", "level", "n_hashes", F.col("best.n").alias("n_linked"), F.col("best.holder").cast(passages.schema["turn"].dataType).alias("quoted_turn"))


def as_mail(messages: DataFrame, parents: DataFrame) -> DataFrame:
    """Messages written as mail: above its own text each quotes the one it replies to (``parents``: conv_id, turn,
    parent_turn), and deeper what that one replies to."""
    one = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    said = one.join(parents, ["conv_id", "turn"], "left")
    p, g = (said.toDF("conv_id", f"{k}_turn", f"{k}_role", f"{k}_text", f"{k}_parent") for k in "pg")
    rows = messages.join(parents, ["conv_id", "turn"], "left").withColumnRenamed("parent_turn", "p_turn")
    rows = rows.join(p, ["conv_id", "p_turn"], "left").withColumnRenamed("p_parent", "g_turn").join(g, ["conv_id", "g_turn"], "left")
    marked = lambda text, mark: F.regexp_replace(text, "(?m)^", mark)
    said_by = lambda k: F.concat(F.lit("On turn "), f"{k}_turn", F.lit(" "), F.coalesce(f"{k}_role", F.lit("someone")), F.lit(" wrote:"))
    above = F.concat_ws("\n", F.when(F.col("g_text").isNotNull(), F.concat(F.lit("> "), said_by("g"))), marked(F.col("g_text"), "> > "), marked(F.col("p_text"), "> "))
    body = F.when(F.col("p_text").isNotNull(), F.concat_ws("\n", said_by("p"), above, F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", body.alias("text"))


def thread_roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of messages with a parent_turn, by doubling: each round halves what is left."""
    ways = replies.select("conv_id", "turn", F.col("parent_turn").alias("to"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done"))
    ways = written(ways, "ways")
    while ways.where("not done").limit(1).count():
        far = ways.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        ways = ways.join(far, ["conv_id", "to"], "left").select("conv_id", "turn", F.coalesce("next", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("next").isNull() | F.col("ends")).alias("done"))
        ways = written(ways, "ways")
    return ways.select("conv_id", "turn", F.col("to").alias("root_turn"), "depth")


def reply_threads(messages: DataFrame) -> DataFrame:
    """One row per message without its quotes: conv_id, turn, role, text, parent_turn, root_turn, depth, n_links.

    In order of (conv_id, root_turn, turn) every message comes after what it replies to, threads one after another.
    """
    passages = written(message_passages(messages), "passages")
    links = written(quote_links(passages), "quote-links")
    parents = links.groupBy("conv_id", "turn").agg(F.min_by("quoted_turn", F.struct("level", "at")).alias("parent_turn"), F.count(F.lit(1)).alias("n_links"))
    parents = written(parents, "parents")
    roots = thread_roots(parents)
    known = parents.join(roots, ["conv_id", "turn"]).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "parent_turn", "root_turn", "depth", "n_links")
    rows = passages.drop("passages").join(known, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    return rows.select("conv_id", "turn", "role", "text", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def conversations(messages: DataFrame) -> DataFrame:
    """``reply_threads`` in order; the sort splits a long conversation by its turns."""
    return reply_threads(messages).orderBy("conv_id", "root_turn", "turn")
