"""Connected components of links, by contraction in rounds; no vertex's links come together in one task.

In a round each vertex hooks onto the least of itself and its neighbours, in an order of
ids that differs from round to round (ids xor a number of the round), so that the number
of vertices shrinks by a part each round, for long chains and large stars alike. Links are
then renamed and loops and repeats dropped, until no more than ``MOST_LINKS`` are left: so few
are joined by one task, to the same components as by further rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavista.llm.shared import random_words, stored

# Links, of 16 bytes each, that one task joins.
MOST_LINKS = 1 << 17


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each end of the links, and the least of its component."""
    links = [np.stack([batch["a"].to_numpy(), batch["b"].to_numpy()]) for batch in batches]
    ids, ends = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *links], axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pa.record_batch({"v": pa.array(ids), "to": pa.array(ids[root])})


def components(links: DataFrame) -> DataFrame:
    """``vertex, component`` for all ids of ``links(a, b)``; a component is named by its smallest id."""
    salts = random_words(9, 64).view("int64").tolist()
    left = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, hooks = stored(left, "links"), []
    while n := left.count():
        if n <= MOST_LINKS:
            hooks.append(stored(left.repartition(1).mapInArrow(_rooted, "v long, to long"), "hooks"))
            break
        salt = F.lit(salts[len(hooks) % len(salts)])
        ends = left.select(F.col("a").alias("v"), F.col("b").alias("w")).union(left.select("b", "a"))
        least = F.min(F.col("w").bitwiseXOR(salt))
        hook = ends.groupBy("v").agg(F.least(least, F.first(F.col("v")).bitwiseXOR(salt)).bitwiseXOR(salt).alias("to"))
        hook = stored(hook, "hooks")
        hooks.append(hook)
        left = left.join(hook.toDF("a", "_a"), "a").join(hook.toDF("b", "_b"), "b").filter("_a <> _b")
        left = stored(left.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    if not hooks:
        return links.select(F.col("a").alias("vertex"), F.col("b").alias("component")).limit(0)
    named = hooks[0].toDF("vertex", "root")
    for hook in hooks[1:]:
        named = named.join(hook.toDF("root", "_to"), "root", "left")
        named = named.select("vertex", F.coalesce("_to", "root").alias("root"))
    named = stored(named, "roots")
    least = named.groupBy("root").agg(F.min("vertex").alias("component"))
    return stored(named.join(stored(least, "least"), "root").select("vertex", "component"), "components")
