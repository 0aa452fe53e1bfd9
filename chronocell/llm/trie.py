"""The trie of conversation prefixes, with sums over subtrees by heavy paths.

A node is a sequence of first turns; its key is its depth and an exclusive-or over the hashes of its
turns with their depths, which is the same for equal sequences, grows by one turn at a time and,
unlike a chain of hashes, can be carried over chunks of a conversation.

Each node's largest child, by members, is on its path; the others begin paths of their own, so from
any node to the root there are at most log2(members) light edges.  The head of every path is found
by pointer jumping.  Paths without light children that wait are summed from their ends, in stretches
of bounded length with carries between them, and their totals go to the parents of their heads:
round by round, as many as light edges lie above one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocell.llm import ordered
from chronocell.sources.scratch import Scratch

#: A rebuilt conversation takes its first turns from the first of so many, and fewer of them than the second number.
FAMILY, MOST = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()
EARLIER = (Window.unboundedPreceding, -1)


def _hashes(depth: Column, said: Column) -> tuple[Column, Column]:
    """What a turn adds to the key: two hashes of its depth and digest."""
    return F.xxhash64(depth.cast("long"), said), F.xxhash64(said, depth.cast("long"), F.lit("second"))


def _folded(hashes: Column, n: Column) -> Column:
    """The exclusive-or of the first ``n`` of an array."""
    return F.aggregate(F.slice(hashes, F.lit(1), n), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def _chunks(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, chunk, start, items``: turns in order as ``said`` (a digest) and ``bytes``, after ``start`` earlier ones."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(32)))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", ordered.beginning(role).alias("r"), ordered.beginning(text).alias("t"), said.alias("said"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("tie"))
    rows = ordered.placed(rows, "conv_id", "turn", "r", "t", "said", "tie").withColumn("chunk", ordered.chunk())
    items = F.array_sort(F.collect_list(F.struct("place", "said", "bytes"))).alias("items")
    packed = rows.groupBy("conv_id", "chunk").agg(items).select("conv_id", F.col("items")[0]["place"].alias("chunk"), "items")
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(*EARLIER)
    return scratch.keep(packed.withColumn("start", F.coalesce(F.sum(F.size("items")).over(before), F.lit(0)).cast("long")), "chunks")


def _plans(chunks: DataFrame) -> DataFrame:
    """``conv_id, n, h, head``: a conversation's turns, how many it takes from its family's first, and those."""
    first = F.when(F.col("start") < MOST - 1, F.struct("start", F.slice("items", F.lit(1), F.lit(MOST - 1)).alias("items")))
    convs = chunks.groupBy("conv_id").agg(F.sum(F.size("items")).cast("long").alias("n"), F.array_sort(F.collect_list(first)).alias("parts"))
    convs = convs.select("conv_id", "n", F.flatten("parts.items").alias("first"))
    heads = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("taken"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h).join(heads, "base", "left")
    return own.select("conv_id", "n", "h", F.coalesce(F.slice("taken", F.lit(1), F.col("h")), F.slice("first", F.lit(1), F.lit(0))).alias("head"))


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, depth, hi, lo, phi, plo, bytes, ends``: every prefix of every rebuilt conversation, the empty one too.

    ``hi, lo`` with the depth are its key, ``phi, plo`` its parent's; ``bytes`` is the length of its last text, ``ends`` whether it is all.
    """
    chunks = _chunks(turns, scratch)
    plans = scratch.keep(_plans(chunks), "plans")
    taken = F.size("head")
    length = taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    x = F.transform("head", lambda e, i: _hashes(i + 1, e["said"])[0])
    y = F.transform("head", lambda e, i: _hashes(i + 1, e["said"])[1])
    plans = plans.withColumn("x", x).withColumn("y", y).withColumn("length", length)
    none = F.lit(0).cast("long")
    roots = plans.select("conv_id", none.alias("depth"), none.alias("hi"), none.alias("lo"), none.alias("phi"), none.alias("plo"), none.alias("bytes"), (F.col("length") == 0).alias("ends"))
    each = plans.select("conv_id", "length", "x", "y", F.posexplode("head").alias("i", "e"))
    upto = F.col("i") + 1
    heads = each.select("conv_id", upto.cast("long").alias("depth"), _folded(F.col("x"), upto).alias("hi"), _folded(F.col("y"), upto).alias("lo"), _folded(F.col("x"), F.col("i")).alias("phi"), _folded(F.col("y"), F.col("i")).alias("plo"), F.col("e.bytes").alias("bytes"), (upto == F.col("length")).alias("ends"))

    known = plans.select("conv_id", "h", "length", taken.alias("taken"), _folded(F.col("x"), taken).alias("hx"), _folded(F.col("y"), taken).alias("hy"))
    own = chunks.join(known, "conv_id").select("conv_id", "chunk", "start", "h", "length", "taken", "hx", "hy", F.posexplode("items").alias("i", "e"))
    own = own.withColumn("place", F.col("start") + F.col("i") + 1).where("place > h").withColumn("depth", (F.col("taken") + F.col("place") - F.col("h")).cast("long"))
    hashes = _hashes(F.col("depth"), F.col("e.said"))
    own = scratch.keep(own.select("conv_id", "chunk", "depth", hashes[0].alias("x"), hashes[1].alias("y"), "hx", "hy", F.col("e.bytes").alias("bytes"), (F.col("depth") == F.col("length")).alias("ends")), "own")
    totals = own.groupBy("conv_id", "chunk").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.first("hx").alias("hx"), F.first("hy").alias("hy"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(*EARLIER)
    carry = [F.coalesce(F.bit_xor(c).over(before), F.lit(0)).bitwiseXOR(F.col(f"h{c}")).alias(f"c{c}") for c in "xy"]
    within = Window.partitionBy("chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.join(totals.select("chunk", *carry), "chunk")
    own = own.withColumn("hi", F.bit_xor("x").over(within).bitwiseXOR(F.col("cx"))).withColumn("lo", F.bit_xor("y").over(within).bitwiseXOR(F.col("cy")))
    own = own.select("conv_id", "depth", "hi", "lo", F.col("hi").bitwiseXOR(F.col("x")).alias("phi"), F.col("lo").bitwiseXOR(F.col("y")).alias("plo"), "bytes", "ends")
    return roots.unionByName(heads).unionByName(own)


def _end_digests(rows: DataFrame) -> DataFrame:
    """``depth, hi, lo, ends_sha256`` of the nodes that conversations end at: their ids in order, comma-joined."""
    node = ["depth", "hi", "lo"]
    ends = ordered.placed(rows.where("ends").select(*node, "conv_id"), *node, "conv_id").withColumn("chunk", ordered.chunk())
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy(*node, "chunk").agg(ids.alias("ids"))

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, digest = None, None
        for depth, hi, lo, ids in rows:
            if (depth, hi, lo) != at:
                if at is not None:
                    yield (*at, digest.hexdigest())
                at, digest = (depth, hi, lo), hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        if at is not None:
            yield (*at, digest.hexdigest())

    sorted_parts = parts.repartition(*node).sortWithinPartitions(*node, "chunk").drop("chunk")
    return ordered.per_row(sorted_parts, run, "depth long, hi long, lo long, ends_sha256 string")


def _tree(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` as ``conv_id, depth, parent, n_convs, n_children, heavy, saved, hi, lo``.

    From here a node is named by its smallest member and its depth, its parent by ``parent`` and the depth before.
    """
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent"))
    kin = scratch.keep(nodes.join(up, ["depth", "phi", "plo"], "left").drop("phi", "plo"), "kin")
    largest = F.max_by("conv_id", F.struct("n_convs", (-F.col("conv_id")).alias("tie")))
    kids = kin.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), largest.alias("largest"))
    kids = scratch.keep(kids, "kids")
    heavy = kids.select(F.col("largest").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("heavy"))
    key = ["conv_id", "depth"]
    tree = kin.join(kids.drop("largest"), key, "left").join(heavy, key, "left")
    return scratch.keep(tree.select(*key, "parent", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("heavy", F.lit(False)).alias("heavy"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "hi", "lo"), "tree")


def _heads(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, depth, head, top``: the conversation and depth that name the head of each node's path, by pointer jumping."""
    at = F.when(F.col("heavy"), F.struct(F.col("parent").alias("c"), (F.col("depth") - 1).alias("d"))).otherwise(F.struct(F.col("conv_id").alias("c"), F.col("depth").alias("d")))
    up = scratch.keep(tree.select("conv_id", "depth", at.alias("at"), (~F.col("heavy")).alias("found")), "up")
    while not up.where("not found").isEmpty():
        # Nodes that still jump stand equally far below their targets, so no two have the same one.
        further = up.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("at").alias("next"), F.col("found").alias("ends"))
        jumped = up.where("not found").join(further, (F.col("at.c") == F.col("c")) & (F.col("at.d") == F.col("d"))).select("conv_id", "depth", F.col("next").alias("at"), F.col("ends").alias("found"))
        old, up = up, scratch.keep(up.where("found").unionByName(jumped), "up")
        scratch.drop(old)
    return up.select("conv_id", "depth", F.col("at.c").alias("head"), F.col("at.d").alias("top"))


def _summed(rows: DataFrame) -> DataFrame:
    """``rows`` of whole paths with ``leaves`` and ``saved`` summed from each node to its path's end."""
    path, stretch = ["head", "top"], F.expr(f"depth div {ordered.CHUNK}")
    rows = rows.withColumn("stretch", stretch)
    below = Window.partitionBy(*path).orderBy(F.desc("stretch")).rowsBetween(*EARLIER)
    totals = rows.groupBy(*path, "stretch").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    carry = totals.select(*path, "stretch", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in "ls"])
    within = Window.partitionBy(*path, "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.join(carry, [*path, "stretch"])
    return both.select("conv_id", "depth", *path, (F.sum("leaves").over(within) + F.col("l")).alias("leaves"), (F.sum("saved").over(within) + F.col("s")).alias("saved"))


def _subtrees(tree: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, depth, n_leaves, saved_tokens`` of every node."""
    key, path = ["conv_id", "depth"], ["head", "top"]
    nodes = tree.join(_heads(tree, scratch), key).select(*key, *path, "parent", "n_children", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved")
    rest = scratch.keep(nodes, "nodes")
    light = F.col("n_children") - F.least("n_children", F.lit(1))
    # One row a path: how many light children it waits for, and the parent of its head.
    paths = scratch.keep(rest.groupBy(*path).agg(F.sum(light).alias("waits"), F.max(F.when(F.col("depth") == F.col("top"), F.col("parent"))).alias("parent")), "paths")
    rest, done = rest.drop("parent", "n_children"), []
    while not paths.isEmpty():
        ready = paths.where("waits = 0").drop("waits")
        done.append(scratch.keep(_summed(rest.join(ready.drop("parent"), path, "left_semi")), "done"))
        tops = done[-1].where("depth = top").join(ready.where("parent is not null"), path)
        given = tops.groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count(F.lit(1)).alias("n"))
        waiting = rest.join(ready.drop("parent"), path, "left_anti").join(scratch.keep(given, "given"), key, "left")
        rest = scratch.keep(waiting.select(*key, *path, *[(F.col(c) + F.coalesce(c[0], F.lit(0))).alias(c) for c in ("leaves", "saved")], F.coalesce("n", F.lit(0)).alias("n")), "nodes")
        came = rest.where("n > 0").groupBy(*path).agg(F.sum("n").alias("came"))
        paths = scratch.keep(paths.where("waits > 0").join(came, path, "left").select(*path, (F.col("waits") - F.coalesce("came", F.lit(0))).alias("waits"), "parent"), "paths")
        rest = rest.drop("n")
    if not done:
        return tree.select(*key, F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select(*key, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node.

    ``turns`` has ``conv_id, turn, role, text``.  A conversation's turns go by turn, null first,
    then by role and text, repeated rows as often as they are; null roles and texts are empty; rows
    without a ``conv_id`` belong to none.  Every conversation is rebuilt: its first turns, fewer
    than ``MOST`` by a hash of its id, from the first of its family of ``FAMILY``, if that is there.
    ``saved_tokens`` counts bytes of texts that members share, once for each but one of them.  Texts
    take part by a digest and their length, whatever that is; other columns are ignored; an empty
    table gives no node.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    rows = scratch.keep(prefixes(turns, scratch), "prefixes")
    nodes = rows.groupBy("depth", "hi", "lo").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max(F.when(F.col("depth") > 0, F.col("phi"))).alias("phi"), F.max(F.when(F.col("depth") > 0, F.col("plo"))).alias("plo"))
    tree = _tree(scratch.keep(nodes, "keys"), scratch)
    sums = _subtrees(tree, scratch)
    out = tree.join(sums, ["conv_id", "depth"]).join(_end_digests(rows), ["depth", "hi", "lo"], "left")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
