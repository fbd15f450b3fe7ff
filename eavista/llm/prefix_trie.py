"""Conversations as a trie of shared beginnings, found by digests of fixed-length blocks.

1. Turns get their place in the conversation by a sort in ranges, so that a conversation
   of any length is cut over many tasks.
2. ``WIDTH`` turns make a block. A block's digest is the exclusive or of its turns'
   digests, each salted with its place; a beginning's digest is the exclusive or of its
   blocks. So digests add up in any order, in pieces of ``SPAN`` blocks.
3. Conversations are grouped by the digest before a block. Where all siblings of a group
   go on with the same block, its turns are a chain of nodes with the same members, and one
   conversation's turns stand for all. Only where siblings diverge are the turns of all of
   them compared.
4. Values of a subtree add up inside blocks along paths of at most ``WIDTH`` nodes, and
   between blocks by doubling the distance: as many rounds as the number of blocks of
   the longest shared beginning has binary digits.

A node is told by its depth and 128 bits of digest.

Turns are in order of ``turn``, null first; ties by role, then text; rows that repeat are
turns each. Null role or text is empty. Rows without an id belong to no conversation. An
empty table has no nodes, not even a root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eavista.llm.shared import partitions, stored
from eavista.operators.skew import spread_join

# Turns of a block, and blocks whose digests one window runs through.
WIDTH = 4
SPAN = 1024

NODE = ["depth", "a", "b"]


def _at_root() -> dict[str, Column]:
    return {name: F.lit(0).cast("long") for name in NODE}


def ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, n_chars``, and ``n_own``, the conversation's number of turns."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = stored(
        ranges.select(
            "conv_id",
            F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
            F.length("text").cast("long").alias("n_chars"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "turns",
    )
    parts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        "conv_id", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n_own")
    )
    return placed.join(parts, ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "digest", "n_chars", "n_own"
    )


def rebuilt(conversations: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns whose conversations begin with turns of their family's first, and ``(conv_id, n_turns)``.

    Conversation c takes the first h = crc32(c) % ``most`` turns of c - c % ``family`` (fewer
    if it has fewer, none if it is absent), then its own from its h-th on.
    """
    turns = stored(ordered(conversations), "ordered")
    taken = F.crc32(F.col("conv_id").cast("string")) % most
    # One row per conversation: its first turn.
    ids = turns.filter("pos = 0").select("conv_id", "n_own")
    plan = ids.select("conv_id", "n_own", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    sizes = ids.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    plan = plan.join(sizes, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = stored(plan.withColumn("n_turns", F.col("m") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))), "families")

    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < most - 1))
    heads = heads.select(F.col("conv_id").alias("base"), "pos", "digest", "n_chars")
    begun = plan.filter("m > 0").select("conv_id", "base", "m").join(heads, "base").filter("pos < m")
    own = turns.withColumn("h", taken).filter("pos >= h")
    # Few families have a first conversation too short for their wish; only theirs move up.
    short = plan.filter("m < h").select("conv_id", (F.col("h") - F.col("m")).alias("gap"))
    if short.isEmpty():
        own = own.withColumn("gap", F.lit(0).cast("long"))
    else:
        own = _attached(own, short, "conv_id", "pos").withColumn("gap", F.coalesce("gap", F.lit(0)))
    own = own.select("conv_id", (F.col("pos") - F.col("gap")).alias("pos"), "digest", "n_chars")
    return stored(begun.select(*own.columns).unionByName(own), "rebuilt"), plan.select("conv_id", "n_turns")


def _attached(many: DataFrame, one: DataFrame, key: str, spread_on: str) -> DataFrame:
    """``many`` with the columns of its row of ``one``, null where there is none; hot keys in slices."""
    keys = many.select(key).distinct()
    return spread_join(many, keys.join(one, key, "left"), key, spread_on, kept=True)


def _running(blocks: DataFrame) -> DataFrame:
    """Adds the digests before and after each block of a conversation."""
    spans = blocks.withColumn("span", F.floor(F.col("k") / SPAN))
    sums = spans.groupBy("conv_id", "span").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "span", *[_none(F.bit_xor(c).over(earlier)).alias(c) for c in ("sa", "sb")])
    inner = Window.partitionBy("conv_id", "span").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.join(sums, ["conv_id", "span"])
    for lane in ("a", "b"):
        before = _none(F.bit_xor(lane).over(inner)).bitwiseXOR(F.col(f"s{lane}"))
        spans = spans.withColumn(f"before_{lane}", before)
    return spans.select(
        "conv_id", "k", "size", "before_a", "before_b",
        F.col("before_a").bitwiseXOR(F.col("a")).alias("after_a"),
        F.col("before_b").bitwiseXOR(F.col("b")).alias("after_b"),
    )


def _none(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def _top(depth: Column, a: str, b: str) -> Column:
    return F.struct(depth.cast("long").alias("depth"), F.col(a).alias("a"), F.col(b).alias("b"))


def blocks_of(turns: DataFrame) -> DataFrame:
    """A row per conversation and block ``k``: its number of turns, the digests before and after it."""
    blocks = turns.groupBy("conv_id", F.floor(F.col("pos") / WIDTH).alias("k")).agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("size")
    )
    return stored(_running(blocks).withColumn("top", _top(F.col("k") * WIDTH, "before_a", "before_b")), "blocks")


def _refined(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row per node: members, parent, block top, path of nodes from the top down to it."""
    after = F.struct("size", "after_a", "after_b")
    groups = blocks.groupBy("top").agg(
        F.min(after).alias("lo"), F.max(after).alias("hi"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")
    )
    known = spread_join(blocks.select("conv_id", "k", "top"), groups, "top", spread_on="conv_id", kept=True)
    diverge = F.col("lo") != F.col("hi")
    asked = known.filter(diverge | (F.col("conv_id") == F.col("least"))).select(
        "conv_id", "k", "top", F.when(diverge, 1).otherwise(F.col("n")).cast("long").alias("weight")
    )
    rows = turns.withColumn("k", F.floor(F.col("pos") / WIDTH)).join(asked, ["conv_id", "k"])
    upto = Window.partitionBy("conv_id", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({lane: F.bit_xor(lane).over(upto).bitwiseXOR(F.col("top")[lane]) for lane in ("a", "b")})
    rows = rows.withColumn("depth", F.col("pos") + 1)
    rows = rows.withColumn("path", F.collect_list(F.struct(*NODE)).over(upto))
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        *[F.first(c).alias(c) for c in ("n_chars", "path", "top")],
    )
    parent = F.when(F.size("path") > 1, F.try_element_at("path", F.lit(-2))).otherwise(F.col("top"))
    return nodes.withColumn("parent", parent)


def _between_blocks(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``top, below_leaves, below_saved``: sums over all nodes below the top of a block."""
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    below = stored(nodes.groupBy("top").agg(*sums), "below")
    # A top's ancestors are found in the blocks of its least member, a row each.
    tops = below.select(F.col("top.depth").alias("depth"), F.col("top.a").alias("a"), F.col("top.b").alias("b"))
    tops = tops.join(nodes.select(*NODE, "conv_id"), NODE)
    tops = stored(tops.withColumn("k", F.floor(F.col("depth") / WIDTH)), "tops")
    most = tops.agg(F.max("k")).first()[0] or 0
    step = 1
    while step <= most:
        above = blocks.select("conv_id", (F.col("k") + step).alias("k"), F.col("top").alias("above"))
        jumps = tops.join(above, ["conv_id", "k"]).select(F.struct(*NODE).alias("top"), "above")
        sent = below.join(jumps, "top").select(F.col("above").alias("top"), "leaves", "saved")
        below = stored(below.unionByName(sent).groupBy("top").agg(*sums), "below")
        step *= 2
    return below.select("top", F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, which come in order: only a hash is kept, not the ids."""
    key, state, out = None, None, []

    def table() -> pa.RecordBatch:
        depths, a, b, digests = zip(*out)
        return pa.record_batch({
            "depth": pa.array(depths, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
            "ends_sha256": pa.array(digests, pa.string()),
        })

    for batch in batches:
        if not len(batch):
            continue
        columns = [batch[c].to_numpy() for c in NODE]
        change = np.zeros(len(batch), bool)
        change[0] = True
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        ids = batch["conv_id"].to_numpy()
        for i, j in zip(starts, [*starts[1:], len(batch)]):
            now = tuple(int(c[i]) for c in columns)
            text = ",".join(map(str, ids[i:j].tolist())).encode()
            if now == key:
                state.update(b"," + text)
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = now, hashlib.sha256(text)
        if out:
            yield table()
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield table()


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the conversations ``ids`` (conv_id, n_turns), whose ``turns`` are conv_id, pos, digest, n_chars.

    Per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (code points that a cache of the
    subtree's turns need not read again), ``ends_sha256`` of the ids of members that end here.
    """
    lanes = {lane: F.xxhash64(F.lit(i), "pos", "digest") for i, lane in enumerate(("a", "b"))}
    turns = turns.withColumns(lanes)
    blocks = blocks_of(turns)
    nodes = stored(_refined(turns, blocks), "nodes")

    children = nodes.groupBy(*[F.col(f"parent.{c}").alias(c) for c in NODE]).agg(F.count(F.lit(1)).alias("n_children"))
    children = stored(children, "children")
    whole = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = whole.withColumns(_at_root())
    valued = nodes.join(children, NODE, "left").withColumns({
        "n_children": _none(F.col("n_children")),
        "leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("n_chars"),
    })
    valued = stored(valued, "valued")
    below = _between_blocks(valued, blocks)

    deep = below.select("top.*", "below_leaves", "below_saved")
    held = valued.join(deep, NODE, "left").select(
        F.explode("path").alias("node"),
        (F.col("leaves") + _none(F.col("below_leaves"))).alias("leaves"),
        (F.col("saved") + _none(F.col("below_saved"))).alias("saved"),
    )
    sums = held.groupBy("node.depth", "node.a", "node.b").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    top = root.join(children, NODE, "left").join(deep, NODE, "left").select(
        *NODE, "conv_id", "n_convs", _none(F.col("n_children")).alias("n_children"),
        F.coalesce("below_leaves", F.lit(1).cast("long")).alias("n_leaves"), _none(F.col("below_saved")).alias("saved_tokens"),
    )
    inner = valued.select(*NODE, "conv_id", "n_convs", "n_children", "parent").join(sums, NODE)
    parents = valued.select(F.struct(*NODE).alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = parents.unionByName(root.select(F.struct(*NODE).alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    inner = spread_join(stored(inner, "sums"), parents, "parent", spread_on="conv_id", kept=True).drop("parent")
    every = inner.unionByName(top.withColumn("parent_conv_id", F.lit(None).cast("long")))

    last = blocks.select(
        "conv_id", "k", "size", (F.col("k") * WIDTH + F.col("size")).alias("depth"),
        F.col("after_a").alias("a"), F.col("after_b").alias("b"),
    )
    done = ids.filter("n_turns > 0").select("conv_id", F.floor((F.col("n_turns") - 1) / WIDTH).alias("k"))
    ends = done.join(last, ["conv_id", "k"]).select(*NODE, "conv_id")
    ends = ends.unionByName(ids.filter("n_turns = 0").select("conv_id").withColumns(_at_root()).select(*NODE, "conv_id"))
    # SHA-256 runs through a node's ids in order, so they pass through one task as a stream.
    ends = ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    ends = ends.mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
