"""Near duplicates by MinHash bands, odd sketches and an exact check of shingle sets.

1. A pass over the texts: hashes of a document's distinct word shingles, ``SAMPLES``
   minimum hashes, keys of bands of them, and an odd sketch: every sample flips one bit of
   a bitmap. Where two sets agree in a sample, its flips cancel in the XOR of their
   bitmaps, so its population count tells how many samples differ.
2. Documents with equal sets are one from here on.
3. In each band's bucket documents are held against its first one, the hub, by odd sketch.
   Those that its sketch rules out are held against the whole bucket, in tiles of two
   blocks. Of the pairs that are not ruled out only a spanning forest of each tile leaves
   it; its components, taken over all buckets, are the clusters: no link leaves a cluster.
4. The texts of a cluster come together once. A task compares on full sets the pairs that
   the sketches do not rule out, nearest first, and skips pairs that it has joined already,
   as the result is the components. No step writes out the pairs of a group.
5. A cluster of more than ``MOST_DOCUMENTS`` or ``MOST_SHINGLES`` does not fit a task. Each
   of its documents is confirmed against its nearest hub; buckets that still hold several
   components then come in tiles of two blocks with their texts, compared like a cluster.

The number of bands is the least with which a pair just at the threshold is missed with
less than ``MISSED`` probability; the sketches' margin is of ``MARGIN`` standard deviations.

Words are runs of bytes other than white space of ASCII, A-Z in lower case. A document
with fewer words than a shingle has one shingle, all its words; without words, or with
null text, it has none and links with nothing. A null id links with nothing and is kept.
Rows that repeat an id are one vertex: their texts are compared each, and what any of them
links with is linked with all. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavista.llm.components import components
from eavista.llm.marked import bitmap, without
from eavista.llm.shared import lean, lean_group, longs, mixed, random_words, slices, small_batches, stored, utf8
from eavista.llm.tokens import LOWER, inverse_powers, prefix_hashes, stretch_hashes

SAMPLES = 128
ROWS = 4
MISSED = 1e-5
SKETCH_BITS = 512
MARGIN = 4.0
# Documents of a bucket that are compared with as many others in a tile, and members of a hub's group.
BLOCK = 1024
GROUP = 64
# What a task takes as one cluster; larger ones are cut into tiles.
MOST_DOCUMENTS = 4096
MOST_SHINGLES = 1 << 22
CHUNK = 1 << 20

MULTIPLIERS = random_words(91, SAMPLES) | np.uint64(1)
ADDENDS = random_words(92, SAMPLES)


def bands(threshold: float) -> int:
    needed = math.ceil(math.log(MISSED) / math.log(1 - threshold**ROWS))
    return min(max(needed, 1), SAMPLES // ROWS)


def most_apart(threshold: float) -> int:
    """Bits by which the sketches of a pair at the threshold may differ."""
    similarity = max(0.0, threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / SAMPLES))
    flips = 2 * SAMPLES * (1 - similarity)
    mean = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
    return math.ceil(mean + 2 * math.sqrt(mean / 4))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's shingles."""
    data = LOWER[data]
    rows = len(offsets) - 1
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    starts[firsts] = solid[firsts]
    starts = np.flatnonzero(starts)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * rows
    stop = ~solid
    bounds = np.union1d(np.flatnonzero(stop), offsets[1:])
    ends = bounds[np.searchsorted(bounds, starts, "right")] if len(bounds) else np.full(len(starts), len(data))
    hashes = stretch_hashes(prefix_hashes(data), inverse_powers(len(data)), starts, ends)
    at = np.searchsorted(starts, offsets)
    keys = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - words + 1
    if n > 0:
        for k in range(words):
            keys[:n] = mixed(keys[:n] * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(keys[a : b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + h)
            out.append(mixed(whole + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes, a row per (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SAMPLES), np.uint64)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat(flat * MULTIPLIERS[j] + ADDENDS[j], starts)
    return out


def odd_sketches(found: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words."""
    place = mixed(found ^ ADDENDS) % np.uint64(SKETCH_BITS)
    rows = np.arange(len(found))[:, None] * SKETCH_BITS
    bits = np.bincount((rows + place.astype(np.int64)).ravel(), minlength=len(found) * SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(found), SKETCH_BITS), axis=1)


def _sketched(words: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for i, j in slices(offsets, CHUNK):
                at = offsets[i : j + 1]
                sets = shingles(data[at[0] : at[-1]], at - at[0], words)
                full = [r for r, s in enumerate(sets) if len(s)]
                n, one, two = np.array([len(s) for s in sets]), np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                keys: list = [None] * (j - i)
                sketches: list = [None] * (j - i)
                if full:
                    some = [sets[r] for r in full]
                    found = samples(some)
                    key = np.zeros((len(full), n_bands), np.uint64)
                    for k in range(ROWS):
                        key = mixed(key * np.uint64(31) + found[:, k : n_bands * ROWS : ROWS])
                    key = mixed(key + np.arange(n_bands, dtype=np.uint64))
                    odd = odd_sketches(found)
                    for row, r in enumerate(full):
                        keys[r], sketches[r] = key[row].view(np.int64), odd[row].tobytes()
                        one[r] = np.bitwise_xor.reduce(some[row])
                        two[r] = mixed(some[row] + np.uint64(7)).sum()
                yield pa.record_batch({
                    "doc_id": batch["doc_id"].slice(i, j - i), "n": pa.array(n), "one": longs(one), "two": longs(two),
                    "keys": pa.array(keys, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary()),
                })

    return run


def _near(limit: int):
    """Bits by which the sketches of a document and its bucket's hub differ, and whether the pair stays possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_words_of(batch[c]) for c in ("sketch", "other"))
            apart = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)
            rows = {c: batch[c] for c in ("key", "hub", "doc", "sketch")}
            yield pa.record_batch(rows | {"apart": pa.array(apart), "near": pa.array(apart <= limit)})

    return run


def _words_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH_BITS // 64)


def _possible(limit: int):
    """A tile per row: a link from each document to the least of those that possible pairs lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(len(batch)):
                tile = batch["tile"][i].values
                asks, ids, sketch = tile.field("asks").to_numpy(zero_copy_only=False), tile.field("doc").to_numpy(), _words_of(tile.field("sketch"))
                left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
                near = np.zeros((len(left), len(right)), bool)
                for k in range(0, len(left), 64):
                    rows = left[k : k + 64]
                    near[k : k + 64] = np.bitwise_count(sketch[rows][:, None] ^ sketch[right][None]).sum(axis=2) <= limit
                near &= ids[left][:, None] != ids[right][None]
                if not near.any():
                    continue
                low, high, none = ids[left].copy(), ids[right].copy(), np.iinfo(np.int64).max
                while True:
                    x = np.minimum(low, np.where(near, high, none).min(1))
                    y = np.minimum(high, np.where(near, x[:, None], none).min(0))
                    if (x == low).all() and (y == high).all():
                        break
                    low, high = x, y
                found.append(np.stack([np.concatenate([low, high]), np.concatenate([ids[left], ids[right]])]))
            a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.record_batch({"a": pa.array(a[a != b]), "b": pa.array(b[a != b])})

    return run


def _joined(limit: int, words: int, percent: int):
    """Links of a cluster, or between the sides of a tile, on full sets; none between those already joined."""

    def run(tile: pa.Table) -> pa.Table:
        ids, named, found = tile["doc"].to_numpy(), tile["component"].to_numpy().copy(), []
        order = np.argsort(ids, kind="stable")
        sketch = _words_of(tile["sketch"])
        side = tile["side"].to_numpy() if "side" in tile.column_names else None
        data, offsets = utf8(tile["text"].combine_chunks())
        kept: dict[int, np.ndarray] = {}

        def own(row: int) -> np.ndarray:
            if row not in kept:
                at = offsets[row : row + 2]
                (kept[row],) = shingles(data[at[0] : at[1]], at - at[0], words)
            return kept[row]

        for k, row in enumerate(order.tolist()):
            if side is None:
                others = order[k + 1 :]
            elif side[row] == 0:
                others = order[side[order] == 1]
            else:
                continue
            others = others[named[others] != named[row]]
            apart = np.bitwise_count(sketch[row] ^ sketch[others]).sum(axis=1)
            others, apart = others[apart <= limit], apart[apart <= limit]
            for other in others[np.argsort(apart, kind="stable")].tolist():
                if named[row] == named[other]:
                    continue
                x, y = own(row), own(other)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found.append((ids[row], ids[other]))
                    named[named == named[other]] = named[row]
        a, b = (np.array([p[k] for p in found], np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _confirmed(words: int, percent: int):
    """Links of a group: the hub's text and those held against it, on full sets."""

    def run(group: pa.Table) -> pa.Table:
        data, offsets = utf8(group["text"].combine_chunks())
        ids, hubs, found = group["doc"].to_pylist(), group["hub"].to_pylist(), []
        hub = None
        for row in sorted(range(len(ids)), key=lambda r: ids[r] != hubs[r]):
            at = offsets[row : row + 2]
            (own,) = shingles(data[at[0] : at[1]], at - at[0], words)
            if hub is None:
                hub = own
                continue
            both = len(np.intersect1d(hub, own, assume_unique=True))
            if 100 * both >= percent * (len(hub) + len(own) - both) and both:
                found.append((hubs[row], ids[row]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _confirm(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough, in groups of a hub and some it is held against."""
    sizes = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "hubs")
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)).cast("int")
    held = pairs.join(sizes, "a").select(F.col("a").alias("hub"), part.alias("part"), F.col("b").alias("doc"))
    held = stored(held, "held")
    need = held.union(held.select("hub", "part", F.col("hub").alias("doc")).distinct())
    rows = need.join(texts, "doc")
    return rows.groupBy("hub", "part").applyInArrow(lean_group(_confirmed(words, percent)), "a long, b long")


def _tiles(met: DataFrame) -> DataFrame:
    """Documents that their hub's sketch rules out against all of their bucket: a row per two blocks, of about ``BLOCK`` each."""
    far = F.count_if(~F.col("near"))
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("all"), far.alias("far")).filter("far > 0 and all > 1")
    blocks = sizes.select("key", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("all", "far")))
    rows, place = met.join(blocks, "key"), F.xxhash64("doc")
    held = rows.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("far") - 1)).alias("x"), F.pmod(place, "all").cast("int").alias("y"),
        F.struct(F.lit(False).alias("asks"), "doc", "sketch").alias("row"),
    )
    asks = rows.filter(~F.col("near")).select(
        "key", F.pmod(place, "far").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("y"),
        F.struct(F.lit(True).alias("asks"), "doc", "sketch").alias("row"),
    )
    return held.union(asks).groupBy("key", "x", "y").agg(F.collect_list("row").alias("tile")).select("tile")


def _open_tiles(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, once for each tile they are in.

    Components with more than a block's members in a bucket have blocks of their own,
    which are not held against each other.
    """
    buckets = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    buckets = stored(buckets.filter("low <> high").select("key"), "open")
    members = stored(members.join(buckets, "key"), "members")
    heavy = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    light = members.join(heavy.select("key", "component"), ["key", "component"], "left_anti")
    light = light.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    heavy, light = stored(heavy, "heavy"), stored(light, "light")
    placed = members.join(heavy, ["key", "component"], "left").join(light, "key", "left")
    within = F.coalesce("n", "m")
    placed = placed.select(
        "key", "component", "doc", "sketch",
        F.when(F.col("n").isNotNull(), F.col("component")).alias("owner"),
        F.pmod(F.xxhash64("doc"), F.ceil(within / BLOCK)).cast("int").alias("block"),
    )
    placed = stored(placed, "placed")
    blocks = stored(placed.select("key", "owner", "block").distinct(), "blocks")
    one = blocks.select("key", F.col("owner").alias("o1"), F.col("block").alias("b1"))
    two = blocks.select("key", F.col("owner").alias("o2"), F.col("block").alias("b2"))
    first = F.struct(F.coalesce("o1", F.lit(-1)), F.col("o1").isNull(), "b1")
    second = F.struct(F.coalesce("o2", F.lit(-1)), F.col("o2").isNull(), "b2")
    tiles = one.join(two, "key").filter((first <= second) & ~F.coalesce(F.col("o1") == F.col("o2"), F.lit(False)))
    tiles = stored(tiles.withColumn("tile", F.xxhash64("key", "o1", "b1", "o2", "b2")), "tiles")
    sides = [
        placed.join(
            tiles.select("key", F.col(f"o{k}").alias("_o"), F.col(f"b{k}").alias("block"), "tile").withColumnRenamed("key", "_k")
            .withColumnRenamed("block", "_b"),
            (F.col("key") == F.col("_k")) & (F.col("block") == F.col("_b")) & F.col("owner").eqNullSafe(F.col("_o")),
        ).select("tile", F.lit(k - 1).alias("side"), "doc", "component", "sketch")
        for k in (1, 2)
    ]
    return sides[0].union(sides[1])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: ``doc_id, n_shingles, component_id, kept``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = texts.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return _alone(texts, words, percent)
    # Each text of an id is a vertex of its own at first.
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    rows = stored(texts.withColumn("row_id", own), "rows")
    found = _alone(rows.select(F.col("row_id").alias("doc_id"), "text"), words, percent)
    found = found.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("part"))
    named = rows.select("doc_id", "row_id").join(found.withColumnRenamed("doc_id", "row_id"), "row_id", "left")
    nameless = rows.filter("row_id is null").select(F.col("doc_id"), "text")
    named = stored(named.filter("row_id is not null"), "parts")
    # Then parts that share an id are one, named by its smallest id.
    least = named.groupBy("doc_id").agg(F.min("part").alias("a"))
    joined = components(named.join(least, "doc_id").select("a", F.col("part").alias("b")))
    whole = named.join(joined, F.col("part") == F.col("vertex"), "left")
    whole = stored(whole.select("doc_id", "n_shingles", F.coalesce("component", "part").alias("whole")), "wholes")
    first = whole.groupBy("whole").agg(F.min("doc_id").alias("component_id"))
    out = whole.join(first, "whole").select("doc_id", "n_shingles", "component_id")
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.unionByName(_alone(nameless, words, percent))


def _alone(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The same where no id repeats with another text."""
    threshold = percent / 100
    with small_batches(texts.sparkSession):
        sketched = stored(
            texts.mapInArrow(
                lean(_sketched(words, bands(threshold))),
                "doc_id long, n long, one long, two long, keys array<long>, sketch binary",
            ),
            "sketches",
        )
    # Equal sets are one: the first id stands for them.
    real = sketched.filter("n > 0 and doc_id is not null")
    equal = real.groupBy("n", "one", "two").agg(F.min(F.struct("doc_id", "keys", "sketch")).alias("row"))
    equal = stored(equal.select("n", "one", "two", F.col("row.doc_id").alias("doc"), "row.keys", "row.sketch"), "sets")
    copies = real.join(equal.select("n", "one", "two", "doc"), ["n", "one", "two"]).filter("doc_id <> doc")
    copies = copies.select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    firsts = equal.dropDuplicates(["doc"])

    limit = most_apart(threshold)
    keyed = firsts.select("doc", "sketch", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "sketch")).alias("first")).filter("n > 1")
    met = keyed.join(hubs.select("key", "first"), "key").filter(F.col("first.doc") != F.col("doc"))
    met = met.select("key", F.col("first.doc").alias("hub"), "doc", "sketch", F.col("first.sketch").alias("other"))
    met = stored(met.mapInArrow(lean(_near(limit)), "key long, hub long, doc long, sketch binary, apart long, near boolean"), "met")
    near = met.filter("near").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    possible = stored(near.union(_tiles(met).mapInArrow(lean(_possible(limit)), "a long, b long")).distinct(), "possible")

    clusters = components(possible)
    found = clusters.join(firsts.select(F.col("doc").alias("vertex"), "n", "sketch"), "vertex")
    found = stored(found.select(F.col("vertex").alias("doc"), F.col("component").alias("cluster"), "n", "sketch"), "clusters")
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("shingles"))
    large = stored(sizes.filter((F.col("documents") > MOST_DOCUMENTS) | (F.col("shingles") > MOST_SHINGLES)).select("cluster"), "large")

    # Texts of documents that may be compared; the others stay where they are.
    maybe = bitmap(found.select(F.xxhash64("doc").alias("h")), "h")
    some = texts.filter(maybe(F.xxhash64("doc_id"))).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "doc")
    joined = lean_group(_joined(limit, words, percent))
    whole = found.join(large, "cluster", "left_anti").select("cluster", "doc", F.col("doc").alias("component"), "sketch")
    links = whole.join(some, "doc").groupBy("cluster").applyInArrow(joined, "a long, b long")
    links = stored(links, "links")
    if not large.isEmpty():
        cut = stored(found.join(large, "cluster", "left_semi").select("doc", "sketch").join(some, "doc"), "texts")
        nearest = met.filter("near").groupBy("doc").agg(F.min_by("hub", F.struct("apart", "hub")).alias("a"))
        nearest = nearest.join(cut.select("doc"), "doc", "left_semi").select("a", F.col("doc").alias("b"))
        held = stored(_confirm(cut.select("doc", "text"), nearest, words, percent), "held")
        buckets = met.select("key", "doc").union(met.select("key", F.col("hub").alias("doc")).distinct())
        members = buckets.join(cut.select("doc", "sketch"), "doc").join(components(held), F.col("doc") == F.col("vertex"), "left")
        members = members.select("key", "doc", F.coalesce("component", "doc").alias("component"), "sketch")
        more = _open_tiles(members).join(cut.select("doc", "text"), "doc").groupBy("tile").applyInArrow(joined, "a long, b long")
        links = links.union(held).union(more)
    final = components(links.union(copies))
    rows = sketched.select("doc_id", F.col("n").alias("n_shingles"))
    rows = rows.join(final, F.col("doc_id") == F.col("vertex"), "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are first in their group, with all their columns."""
    groups = near_duplicates(docs, words, percent)
    return without(docs, "doc_id", groups.filter("not kept").select(F.col("doc_id").alias("key")).distinct())
