"""Exact set similarity join of documents on word shingles, by grouped prefixes.

1. Shingles that many documents share are found by mergeable summaries of all documents and put last in the order of
   shingles. The order decides only the cost, never the result.
2. Every document becomes (size, digest of its set, its prefix in that order, a parity sketch). Equal sets are one
   node; nodes of identical prefix and size are one group, and only groups post their prefixes.
3. Every group first meets the hubs of its posting lists: of those of about its size the one whose prefix reaches the
   shared shingle soonest, which has the fewest shingles of its own and so is the nearest to all others. Members meet
   the head of their group. What is verified is joined into components; so a large group of near copies costs a pair
   or two for each row and list.
4. Members outside the largest component of a list then meet that component's hub, in the same way.
5. Last, every pair of groups that shares a prefix shingle and could still join two components is expanded to members,
   filtered by size, position and sketch, and verified on whole sets. So no link between components is lost, and
   pairs inside a component, which can't change it, aren't made.

Lists are counted and hubs chosen by aggregates, which are combined before they move; no window or array gathers a list.

A parity sketch has one bit for each value of a hash of shingles, set if an odd number of them fall on it: the bits in
which two sketches differ never outnumber the shingles in which the sets differ, so no true pair fails the filter. One
sketch of fixed width filters inside the join; one of a bit a shingle filters the pairs that come out of it, before
whole sets are brought together.

Defined results: null and empty texts have size 0 and are linked with nothing; a text of fewer words than a shingle is
one shingle; equal sets always share a component; doc_id is the key: repeated rows get the same result each, rows
without doc_id take the component of an equal set, if any, and add no links. Empty tables give empty results; other
columns are not touched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .hashing import SPACE, Words, give_back, raw_text, row_blocks, shingle_sets
from .idmaps import MAP_BITS, id_map

#: Shingles in a task's summary, and in the list that all tasks get (16 bytes each), at most.
COUNTERS, FREQUENT = 65_536, 131_072
#: Cells that count the shingles a task has seen, a byte each.
CELLS = 1 << 24
#: 64-bit words of a sketch.
SKETCH = 32
_WORDS = [f"s{k}" for k in range(SKETCH)]
_DIGEST, _GROUP = ["d0", "d1"], ["g0", "g1"]


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = raw_text(column)
    for a, b in row_blocks(offsets):
        yield a, shingle_sets(Words(data, offsets[a : b + 1], SPACE, lower=True), n)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key; beyond COUNTERS keys all lose what the first one too many has."""
    keys, at = np.unique(keys, return_inverse=True)
    sums = np.bincount(at, counts, len(keys)).astype(np.int64)
    if len(keys) > COUNTERS:
        sums -= np.partition(sums, len(sums) - COUNTERS - 1)[len(sums) - COUNTERS - 1]
        keys, sums = keys[sums > 0], sums[sums > 0]
    return keys, sums


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT shingles that many documents have, sorted, and their counts (a little too low).

    A task counts all shingles in cells that several may share; those whose cell is well over the mean are counted
    by themselves from then on, in a summary of bounded size. Summaries add up.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        cells, seen = np.zeros(CELLS, np.uint8), 0
        for batch in batches:
            for _, sets in _sets(batch.column(0), n):
                own, many = np.unique(np.concatenate(sets), return_counts=True)
                at = (own >> np.uint64(40)).astype(np.int64)
                now = np.minimum(cells[at] + many, 255)
                cells[at] = now
                seen += int(many.sum())
                often = (many > 1) | (now > 2 + 4 * (seen // CELLS))
                keys, counts = _summed(np.append(keys, own[often]), np.append(counts, many[often]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["shingle", "low"])
        del cells, keys, counts
        give_back()

    sums = docs.select("text").mapInArrow(summaries, "shingle long, low long").groupBy("shingle").agg(F.sum("low").alias("low"))
    got = sums.where("low > 3").orderBy(F.col("low").desc(), "shingle").limit(FREQUENT).toPandas()
    keys = got["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["low"].to_numpy(np.int64)[order]


def _sketch(values: np.ndarray, words: int = SKETCH) -> np.ndarray:
    bits = np.bincount((values >> np.uint64(20)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _wide(values: np.ndarray) -> np.ndarray:
    """A sketch of about a bit for each shingle, in a power of two of words."""
    return _sketch(values, max(SKETCH, 1 << max(0, (len(values) - 1) // 64).bit_length()))


def _two_longs(data: bytes, salt: int) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(data, digest_size=16, salt=salt.to_bytes(8, "little")).digest(), np.int64)


def signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, size, and for non-empty sets prefix, digest (d0, d1), digest of prefix and size (g0, g1), a sketch of
    fixed and one of growing width."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for batch in batches:
            for a, sets in _sets(batch.column(1), n):
                sizes = [len(s) for s in sets]
                prefixes, wide, numbers = [], [], np.zeros((len(sets), 4 + SKETCH), np.int64)
                for i, s in enumerate(sets):
                    if not len(s):
                        prefixes.append(None), wide.append(None)
                        continue
                    wide.append(_wide(s))
                    numbers[i, :2], numbers[i, 4:] = _two_longs(s.tobytes(), 0), _sketch(s)
                    length = len(s) - -(-num * len(s) // den) + 1
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        often = keys[at] == s
                        s = np.concatenate((s[~often], s[often][np.argsort(counts[at[often]], kind="stable")]))
                    prefix = s[:length].view(np.int64)
                    prefixes.append(prefix)
                    numbers[i, 2:4] = _two_longs(prefix.tobytes(), len(s))
                columns = [batch.column(0).slice(a, len(sets)), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), *map(pa.array, numbers.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "prefix", "wide", *_DIGEST, *_GROUP, *_WORDS])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, size long, prefix array<long>, wide array<long>, " + ", ".join(f"{k} long" for k in (*_DIGEST, *_GROUP, *_WORDS))
    return docs.select("doc_id", "text").mapInArrow(signed, schema)


def _similar_sizes(a: Column, b: Column, num: int, den: int) -> Column:
    return (a * den >= b * num) & (b * den >= a * num)


def _sketches_allow(left: str, right: str, num: int, den: int) -> Column:
    """False only if the sets differ in more shingles than the similarity leaves room for."""
    apart = sum((F.bit_count(F.col(f"{left}.s{k}").bitwiseXOR(F.col(f"{right}.s{k}"))) for k in range(SKETCH)), F.lit(0))
    return apart * (num + den) <= (F.col(f"{left}.size") + F.col(f"{right}.size")) * (den - num)


def _positions_allow(left: str, right: str, num: int, den: int) -> Column:
    """What can be common from a shared shingle on reaches what the similarity asks for. The first shared shingle of a
    similar pair always passes, since nothing before it is common."""
    x, y = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    most = F.least(x("size") - x("pos"), y("size") - y("pos"))
    return most * (num + den) >= (x("size") + y("size")) * num


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, members) for at least the documents in ``wanted`` (node); few others come along."""
    held = id_map(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            b = batch.column(1).to_numpy(zero_copy_only=False)
            own = batch.filter(pa.array((held[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)))
            for a, sets in _sets(own.column(2), n):
                yield pa.RecordBatch.from_arrays([own.column(0).slice(a, len(sets)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "members"])
        give_back()

    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("bit"), "text")
    return rows.mapInArrow(hashed, f"node {docs.schema['doc_id'].dataType.simpleString()}, members array<long>").dropDuplicates(["node"])


def _folded(wide: Column, words: Column) -> Column:
    """A sketch brought to fewer words: parts that fall on each other add up, and parity with them."""
    return F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.aggregate(F.sequence(i, F.size(wide) - 1, words), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.get(wide, k))))


def likely(pairs: DataFrame, signed: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sketches of growing width allow the similarity; the rest can't have it."""
    own = signed.where("size > 0").select("doc_id", "size", "wide")
    both = pairs.join(own.toDF("a", "n", "x"), "a").join(own.toDF("b", "m", "y"), "b")
    words = F.least(F.size("x"), F.size("y"))
    x, y = (F.when(F.size(c) == words, F.col(c)).otherwise(_folded(F.col(c), words)) for c in ("x", "y"))
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return both.where(apart * (num + den) <= (F.col("n") + F.col("m")) * (den - num)).select("a", "b").distinct()


def verified(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(whole_sets(docs, wanted, n).join(wanted, "node", "left_semi"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * (num + den) >= (F.size("x") + F.size("y")) * num).select("a", "b")


def _size_class(size: Column, num: int, den: int) -> Column:
    """Similar sizes are of one class or of neighbouring ones; a hair wider than the ratio, so that rounding is safe."""
    return F.floor(F.log(size.cast("double")) / (math.log(den / num) * (1 + 1e-9))).cast("int")


def shared_lists(posts: DataFrame, num: int, den: int) -> DataFrame:
    """The posts (shingle, gid, size, pos) whose list has others of about their size, with ``cls`` and up to three hubs."""
    lists = posts.join(posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("shingle"), "shingle", "left_semi")
    lists = written(lists.withColumn("cls", _size_class(F.col("size"), num, den)), "lists")
    own = lists.groupBy("shingle", "cls").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "size", "gid")).alias("hub"))
    about = own.select("shingle", "n", "hub", F.explode(F.array(*(F.col("cls") + k for k in (-1, 0, 1)))).alias("cls"))
    about = about.groupBy("shingle", "cls").agg(F.sum("n").alias("n"), F.collect_set("hub").alias("hubs")).where("n > 1").drop("n")
    return lists.join(about, ["shingle", "cls"])


def _likely_members(pairs: DataFrame, sketched: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sizes and sketches of fixed width allow the similarity."""
    side = sketched.select("node", "size", *_WORDS)
    both = pairs.join(side.alias("x"), F.col("a") == F.col("x.node")).join(side.alias("y"), F.col("b") == F.col("y.node"))
    return both.where(_similar_sizes(F.col("x.size"), F.col("y.size"), num, den) & _sketches_allow("x", "y", num, den)).select("a", "b")


def _joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with ``part``, the smallest node of their component with the new links, and its size.

    Only components that a link joins take part in the rounds, so later calls have little to do.
    """
    to = members.select("node", "part")
    ends = links.join(to.toDF("a", "pa"), "a").join(to.toDF("b", "pb"), "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    found = components(ends).toDF("part", "component")
    own = members.drop("part_size").join(found, "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component")
    own = written(own, "parts")
    return written(own.join(own.groupBy("part").agg(F.count(F.lit(1)).alias("part_size")), "part"), "members")


def similar_documents(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Documents are linked when den * common >= num * union over their sets of n-word shingles.
    """
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, n, num, den), "signatures")
    some = signed.where("size > 0 and doc_id is not null")
    # equal digests have equal sets: the columns of any row stand for all
    nodes = written(some.groupBy(*_DIGEST).agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("size", *_GROUP, *_WORDS))), "nodes")
    groups = nodes.groupBy(*_GROUP).agg(F.min("node").alias("gid"), F.count(F.lit(1)).alias("n_members"))
    sketched = written(nodes.drop(*_DIGEST).join(groups, _GROUP).drop(*_GROUP), "members")
    members = sketched.drop(*_WORDS).withColumns({"part": F.col("node"), "part_size": F.lit(1).cast("long")})

    def check(pairs: DataFrame) -> DataFrame:
        likely_pairs = likely(written(pairs, "pairs"), signed, num, den)
        return written(verified(docs, written(likely_pairs, "likely"), n, num, den), "links-found")

    # hubs of posting lists, heads of groups
    heads = members.where("node = gid").select(F.col("gid").alias("doc_id"))
    posts = some.select("doc_id", "size", "prefix").join(heads, "doc_id", "left_semi").select(F.col("doc_id").alias("gid"), "size", F.posexplode("prefix").alias("pos", "shingle"))
    lists = written(shared_lists(posts, num, den), "lists-with-hubs")
    p = lists.select(F.struct("gid", "size", "pos").alias("p"), F.explode("hubs").alias("q")).where("p.gid <> q.gid")
    p = p.where(_similar_sizes(F.col("p.size"), F.col("q.size"), num, den) & _positions_allow("p", "q", num, den))
    first = p.select(F.least("p.gid", "q.gid").alias("a"), F.greatest("p.gid", "q.gid").alias("b")).distinct()
    first = first.unionByName(members.where("node <> gid").select(F.col("gid").alias("a"), F.col("node").alias("b")))
    members = _joined(members, check(_likely_members(first, sketched, num, den)))

    # what is outside the largest component of a list meets the hub of that component
    lists = lists.select("shingle", "cls", "gid", "pos").withColumn("own", F.lit(False))
    alone = members.where("n_members > 1").select("gid").distinct().select(F.xxhash64("gid").alias("shingle"), F.lit(0).alias("cls"), "gid", F.lit(0).alias("pos"), F.lit(True).alias("own"))
    lists = written(lists.unionByName(alone), "all-lists")
    top = _entries(lists, members)
    hubs = top.where("part = top").groupBy("shingle", "own", "cls").agg(F.min(F.struct("pos", "size", "node")).alias("q"))
    others = top.where("part <> top").select("shingle", "own", "cls", F.struct("node", "size", "pos").alias("p"))
    near = hubs.select("shingle", "own", "q", F.explode(F.array(*(F.col("cls") + k for k in (-1, 0, 1)))).alias("cls"))
    p = others.join(near, ["shingle", "own", "cls"]).where(_similar_sizes(F.col("p.size"), F.col("q.size"), num, den) & _positions_allow("p", "q", num, den))
    second = p.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()
    members = _joined(members, check(_likely_members(second, sketched, num, den)))

    # pairs that could still join two components
    entries = written(_entries(lists, members).join(sketched.select("node", *_WORDS), "node"), "entries")
    x, y = entries.where("part <> top").alias("x"), entries.alias("y")
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.own") == F.col("y.own")) & (F.col("x.part") != F.col("y.part"))
    meet &= (F.col("y.part") == F.col("y.top")) | (F.col("x.node") < F.col("y.node"))
    meet &= _similar_sizes(F.col("x.size"), F.col("y.size"), num, den) & _positions_allow("x", "y", num, den) & _sketches_allow("x", "y", num, den)
    last = x.join(y, meet).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    members = _joined(members, check(last))

    classes = nodes.select(*_DIGEST, "node").join(members.select("node", F.col("part").alias("component")), "node").drop("node")
    rows = signed.where("size > 0").select("doc_id", "size", *_DIGEST).join(classes, _DIGEST, "left").select("doc_id", "size", "component")
    rows = rows.unionByName(signed.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component")))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _entries(lists: DataFrame, members: DataFrame) -> DataFrame:
    """Lists of several components, expanded to members: shingle, own, cls, gid, pos, node, size, part, and ``top``, the
    largest component of the list."""
    spread = members.select("gid", "part", "part_size").distinct()
    mixed = lists.join(spread, "gid").groupBy("shingle", "own").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max(F.struct("part_size", "part")).alias("top"))
    mixed = mixed.where("low <> high").select("shingle", "own", F.col("top.part").alias("top"))
    return lists.join(mixed, ["shingle", "own"]).join(members.select("gid", "node", "size", "part"), "gid")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` without those that are linked, over any number of steps, to a smaller doc_id."""
    found = similar_documents(docs, n, num, den)
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti")
