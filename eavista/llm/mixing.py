"""Mixing sources: temperature weights, made real as repeated and shuffled blocks.

A source's weight is its share of the tokens to the power of an exponent between 0
(all sources alike) and 1 (as they are). The exponent is bisected to the largest flattening
that keeps within a repetition limit, or to a given entropy of the weights. The budget of
all sources together, unless given, is the least that uses every source at least once.

A source's rows fall into blocks by a hash of the id; each pass over the source is its own
permutation of the blocks. The last pass ends where the budget does: within a block whose
rows fall, by another hash, into parts, and before the first part that would exceed the
budget. So only sizes of blocks and parts are added up in order, never those of rows, and
a source that holds a third of all rows is no more work for a task than any other.

Tokens are runs of characters other than white space. Null source is a source of its own;
null text counts as empty. A row without tokens, and a source without any, is used in full
passes (at least one where no budget is given). Rows that repeat are rows each. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eavista.llm.shared import free_names, stored

# Most passes over any source.
REPEATS = 2.0
BLOCKS = 256
PARTS = 4096
# Rows of the block table up to which it is broadcast.
BROADCAST_ROWS = 500_000


def weights(sizes: np.ndarray, exponent: float) -> np.ndarray:
    raw = (sizes / sizes.sum()) ** exponent
    return raw / raw.sum()


def entropy(shares: np.ndarray) -> float:
    return float(-(shares * np.log(shares)).sum())


def passes(sizes: np.ndarray, exponent: float, budget: float | None = None) -> np.ndarray:
    """How often each source is used; without a budget, the least used is used once."""
    per_size = weights(sizes, exponent) / (sizes / sizes.sum())
    return per_size / per_size.min() if budget is None else per_size * budget / sizes.sum()


def exponent_for(sizes: np.ndarray, repeats: float | None = REPEATS, target: float | None = None, budget: float | None = None) -> float:
    """The least exponent within the repetition limit, or the one whose weights have the entropy ``target``."""

    def too_flat(exponent: float) -> bool:
        if target is not None:
            return entropy(weights(sizes, exponent)) > target
        return passes(sizes, exponent, budget).max() > repeats

    low, high = 0.0, 1.0
    if not too_flat(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def _planned(rows: DataFrame, repeats, target, budget, seed: int) -> DataFrame:
    """Per pass and block of each source: ``block_rank``, and the number of parts used where not all are."""
    spark = rows.sparkSession
    blocks = stored(rows.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_sum")), "blocks")
    # One row per source reaches the driver.
    totals = sorted((r["_source"], r.n) for r in blocks.groupBy("_source").agg(F.sum("_sum").alias("n")).collect())
    sizes = np.array([n for _, n in totals if n], float)
    found = iter(passes(sizes, exponent_for(sizes, repeats, target, budget), budget) if len(sizes) else [])
    plan = []
    for name, n in totals:
        uses = float(next(found)) if n else 1.0
        whole = int(uses + 1e-9)
        plan += [(name, i, None) for i in range(whole)]
        if n and (last := int((uses - whole) * n)) > 0:
            plan.append((name, whole, last))
    plan = spark.createDataFrame(plan, "_source string, pass_no int, _budget long")
    order = Window.partitionBy("_source", "pass_no").orderBy(
        F.xxhash64(F.lit(seed), "pass_no", "_source", "_block"), "_block"
    )
    before = F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(F.broadcast(plan), "_source").withColumns(
        {"block_rank": F.row_number().over(order) - 1, "_left": F.col("_budget") - before}
    )
    # The block in which a budget ends, of each source that has one.
    ending = placed.filter("_left > 0 and _left < _sum").select("_source", "_block", "_left")
    parts = rows.join(F.broadcast(ending), ["_source", "_block"]).groupBy("_source", "_left", "_part")
    parts = parts.agg(F.sum("_tokens").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_part"))
    fits = parts.withColumn("_fits", upto <= F.col("_left"))
    cut = fits.groupBy("_source").agg(
        F.coalesce(F.min(F.when(~F.col("_fits"), F.col("_part"))), F.lit(PARTS)).alias("_parts")
    )
    placed = placed.filter("_left is null or _left > 0").join(F.broadcast(cut), "_source", "left")
    full = F.col("_left").isNull() | (F.col("_left") >= F.col("_sum"))
    return stored(
        placed.select("_source", "_block", "pass_no", "block_rank", F.when(~full, F.col("_parts")).alias("_parts")), "plan"
    )


OWN = ("_source", "_block", "_part", "pass_no", "block_rank", "_parts")


def _used(docs: DataFrame, repeats, target, budget, seed: int) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs``, each as often as used, and the names of the columns ``OWN`` among theirs."""
    names = free_names(docs, *OWN)
    name = dict(zip(OWN, names))
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    rows = docs.withColumns({
        name["_source"]: source,
        name["_block"]: F.pmod(place, F.lit(BLOCKS)).cast("int"),
        name["_part"]: F.pmod(F.shiftrightunsigned(place, 32), F.lit(PARTS)).cast("int"),
    })
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))
    keys = [F.col(name[key]).alias(key) for key in ("_source", "_block", "_part")]
    sizes = stored(rows.select(*keys, tokens.cast("long").alias("_tokens")), "sizes")
    plan = _planned(sizes, repeats, target, budget, seed)
    few = plan.count() <= BROADCAST_ROWS
    plan = plan.select(*[F.col(key).alias(name[key]) for key in OWN if key != "_part"])
    used = rows.join(F.broadcast(plan) if few else plan, [name["_source"], name["_block"]])
    parts = F.col(name["_parts"])
    return used.filter(parts.isNull() | (F.col(name["_part"]) < parts)), names


def mixed(docs: DataFrame, repeats=REPEATS, target=None, budget=None, seed: int = 10) -> DataFrame:
    """The rows of ``docs``, with their columns, whatever their names, each as often as it is used."""
    used, names = _used(docs, repeats, target, budget, seed)
    return used.drop(*names)


def schedule(docs: DataFrame, repeats=REPEATS, target=None, budget=None, seed: int = 10) -> DataFrame:
    """A row per use: ``doc_id, source, pass_no, block, block_rank``; a pass runs through its blocks by rank."""
    used, _ = _used(docs.select("doc_id", "source", "text"), repeats, target, budget, seed)
    return used.select("doc_id", "source", "pass_no", F.col("_block").alias("block"), "block_rank")
