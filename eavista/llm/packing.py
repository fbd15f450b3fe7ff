"""Packing documents into sequences: a cutting-stock problem solved by column generation.

1. A document's ids (with the end id) are cut into pieces of ``SEQUENCE`` ids and a rest.
   Whole documents of up to that length are never cut. Each text is encoded once.
2. The pieces' lengths form a histogram of at most ``CLASSES`` classes, a length counting
   as the longest of its class. A linear program covers it with patterns (sets of pieces
   that fit one sequence) at the least number of sequences. It starts with one pattern per
   class; a knapsack over the duals, by dynamic programming, prices further ones until
   none is better or the bound shows the gap closed. The driver holds the histogram only.
3. Pattern counts are rounded down; what is left is filled in by decreasing length.
4. Pieces of a class are ranked, and each pattern takes ranges of ranks: the rank alone
   says sequence and slot. Ranks come from counts of buckets within a class, so that a
   class that holds a third of all pieces is ranked by many tasks.

A sequence is padded to ``SEQUENCE``, unless what it holds is a power of two.

Null text counts as empty: one piece with the end id alone. Rows that repeat an id are
packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eavista.llm.shared import lean, partitions, small_batches, stored, utf8
from eavista.llm.tokens import worker_encoder

SEQUENCE = 4096
CLASSES = 512
# Pieces up to this length are told apart exactly and planned in bundles of some BUNDLE ids.
SHORT = 64
BUNDLE = 256
# The linear program stops when it is this near its bound.
GAP = 3e-3

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary, True, end)
        for batch in batches:
            doc_ids = batch["doc_id"]
            for i, j, ids, at in encoder.encode(*utf8(batch["text"])):
                sizes = np.diff(at)
                counts = -(-sizes // SEQUENCE)
                row = np.repeat(np.arange(j - i), counts)
                start = (np.arange(counts.sum()) - (np.cumsum(counts) - counts)[row]) * SEQUENCE
                length = np.minimum(SEQUENCE, sizes[row] - start)
                ids = ids.astype("<u4")
                first = at[:-1][row] + start
                crcs = [zlib.crc32(ids[a : a + n].data) for a, n in zip(first.tolist(), length.tolist())]
                yield pa.record_batch({
                    "doc_id": doc_ids.take(pa.array(row + i)), "start": pa.array(start), "length": pa.array(length),
                    "ids_crc32": pa.array(crcs, pa.int64()), "doc_tokens": pa.array(sizes[row]),
                })

    return run


def knapsack(worth: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The set of items (any number of each) of most worth that fits, by dynamic programming."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_up, worth_up = sizes[order], worth[order]
    upto = np.searchsorted(sizes_up, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            values = best[c - sizes_up[:n]] + worth_up[:n]
            i = int(np.argmax(values))
            if values[i] > best[c] + 1e-12:
                best[c], taken[c] = values[i], order[i]
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            counts[taken[c]] += 1
            c -= sizes[taken[c]]
    return float(best[room]), counts


def patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and how often each is used, fractions too: a covering of least number.

    Revised simplex; a column enters by the knapsack, the inverse of the basis is kept.
    """
    m = len(sizes)
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / (room // sizes))
    used = inverse @ demand
    for step in range(20 * m + 100):
        duals = np.maximum(inverse.sum(axis=0), 0.0)
        value, pattern = knapsack(duals, sizes, room)
        # Duals divided by the best pattern's worth are feasible, which bounds the optimum.
        if value <= 1 + 1e-9 or (duals @ demand) / value >= used.sum() * (1 - gap):
            break
        way = inverse @ pattern
        up = way > 1e-9
        ratios = np.where(up, used / np.where(up, way, 1), np.inf)
        leave = int(np.argmin(ratios))
        pivot = inverse[leave] / way[leave]
        inverse -= np.outer(way, pivot)
        inverse[leave] = pivot
        columns[:, leave] = pattern
        if step % 64 == 63:
            inverse = np.linalg.inv(columns)
        used = np.maximum(inverse @ demand, 0)
    return columns.T.astype(np.int64), used


def plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[int, dict[int, int]]]:
    """Whole numbers: how many sequences hold which pieces per class (by index)."""
    if not len(sizes):
        return []
    found, used = patterns(sizes, demand, room)
    left, out = demand.astype(np.int64).copy(), []
    for pattern, times in zip(found, np.floor(used + 1e-9).astype(np.int64)):
        held = pattern > 0
        times = min(int(times), int((left[held] // pattern[held]).min()))
        if times > 0:
            out.append((times, {int(i): int(pattern[i]) for i in np.flatnonzero(held)}))
            left -= times * pattern
    # The rest: the longest piece that still fits, sequence after sequence, equal ones together.
    down = np.argsort(-sizes, kind="stable")
    while left.any():
        free, held = room, {}
        for i in down:
            if take := min(int(left[i]), int(free // sizes[i])):
                held[int(i)] = take
                free -= take * int(sizes[i])
        times = min(int(left[i]) // n for i, n in held.items())
        for i, n in held.items():
            left[i] -= times * n
        out.append((times, held))
    return out


def items(demand: dict[int, int], unit: int) -> list[dict[str, int]]:
    """What is planned: pieces of a class, or bundles of short ones of one length; sizes in units."""
    out = []
    for kind, n in sorted(demand.items()):
        if kind > SHORT:
            out.append({"kind": kind, "pieces": 1, "size": kind - SHORT, "n": n})
            continue
        for pieces, times in ((BUNDLE // kind, n // (BUNDLE // kind)), (1, n % (BUNDLE // kind))):
            if times:
                out.append({"kind": kind, "pieces": pieces, "size": -(-pieces * kind // unit), "n": times})
    return out


def packed(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    unit = SEQUENCE // CLASSES
    kind = F.when(F.col("length") <= SHORT, F.col("length")).otherwise(F.ceil(F.col("length") / unit) + SHORT).cast("int")
    buckets = max(64, partitions(spark))
    # Equal rows differ by no column, so the bucket of a repeated row is drawn from its place.
    spread = F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    # Written once, with class and bucket: each file made has its cost on an executor.
    pieces = texts.mapInArrow(lean(_pieces(vocabulary, end)), PIECES)
    with small_batches(spark):
        pieces = stored(pieces.select("*", kind.alias("kind"), spread.alias("bucket")), "pieces")
    sizes = pieces.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n"))
    demand = {r.kind: r.n for r in sizes.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    planned = items(demand, unit)
    slots, base, done = [], 0, dict.fromkeys(demand, 0)
    for times, held in plan(*(np.array([x[c] for x in planned], np.int64) for c in ("size", "n")), CLASSES):
        slot, pieces_of = 0, {}
        for i, count in held.items():
            k = planned[i]["kind"]
            pieces_of[k] = pieces_of.get(k, 0) + count * planned[i]["pieces"]
        for k, each in pieces_of.items():
            slots.append((k, done[k], done[k] + times * each, base, each, slot))
            done[k], slot = done[k] + times * each, slot + each
        base += times
    # Rows: patterns times classes in each, whatever the input.
    slots = spark.createDataFrame(slots, "kind int, low long, high long, base long, each long, slot long")

    before = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("kind", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("kind", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("place", F.row_number().over(inner) - 1).join(first, ["kind", "bucket"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("place")).drop("first", "place", "bucket")
    put = ranked.join(
        F.broadcast(slots),
        (ranked["kind"] == slots["kind"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    )
    at = F.col("rank") - F.col("low")
    put = put.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("slot") + at % F.col("each")).alias("slot"),
    )
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    held = F.sum("length").over(Window.partitionBy("sequence_id"))
    return put.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"),
        F.when(F.bit_count(held) == 1, held).otherwise(F.lit(SEQUENCE)).cast("long").alias("padded"),
    )
