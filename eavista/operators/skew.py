"""Joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from eavista.sources.shared import written

# Rows of one key that a task takes before the key is cut into slices.
ROWS_PER_SLICE = 2_000_000

# Keys that a task's summary counts, and the most frequent ones that reach the driver. A key
# that is none of these holds less than one in ``REPORTED`` of all rows.
COUNTED = 100_000
REPORTED = 10_000


def frequent_keys(key: str) -> Column:
    """A mergeable summary: hashes of the most frequent keys with their numbers of rows."""
    return F.expr(f"approx_top_k(xxhash64({key}), {REPORTED}, {COUNTED})")


def with_hot_keys(
    many: DataFrame, key: str, rows_per_slice: int | None = None, kept: bool = False
) -> tuple[DataFrame, dict[int, int]]:
    """``many`` in storage, and by hash the slices of keys with more than ``rows_per_slice`` rows.

    The summary is made while the rows are written, so they are computed once. ``kept``
    says that ``many`` is read from storage already; then it is read for the summary.
    """
    if kept:
        top = many.select(frequent_keys(key)).first()[0]
    else:
        seen = Observation()
        many = written(many.observe(seen, frequent_keys(key).alias("top")))
        top = seen.get["top"]
    limit = rows_per_slice or ROWS_PER_SLICE
    return many, {item: -(-count // limit) for item, count in top or [] if item is not None and count > limit}


def spread_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    spread_on: str,
    rows_per_slice: int | None = None,
    kept: bool = False,
) -> DataFrame:
    """Inner join of ``many`` with ``one`` row per key, hot keys cut into slices.

    Rows of a hot key go to a slice by the hash of ``spread_on``; the matching row
    of ``one`` is repeated once per slice. All other keys join as usual. Adaptive
    execution cannot split such a join when ``one`` is itself the result of joins
    or aggregations on the same key, which is when this is used. ``many`` is written
    once, when the join is built; without a hot key it is a plain join from there.
    """
    # Equal keys have equal hashes in one type only.
    kind = many.select(key).union(one.select(key)).schema[0].dataType
    many, one = (
        frame if frame.schema[key].dataType == kind else frame.withColumn(key, F.col(key).cast(kind))
        for frame in (many, one)
    )
    many, hot = with_hot_keys(many, key, rows_per_slice, kept)
    if not hot:
        return many.join(one, key)
    # At most REPORTED rows.
    slices = F.broadcast(many.sparkSession.createDataFrame(list(hot.items()), "clave long, tramos int"))

    def marked(frame: DataFrame) -> DataFrame:
        return frame.join(slices, F.xxhash64(key) == F.col("clave"), "left").drop("clave")

    count = F.coalesce(F.col("tramos"), F.lit(1))
    sliced = marked(many).withColumn("tramo", F.pmod(F.xxhash64(spread_on), count).cast("int"))
    repeated = marked(one).withColumn("tramo", F.explode(F.sequence(F.lit(0), count - 1)))
    return sliced.drop("tramos").join(repeated.drop("tramos"), [key, "tramo"]).drop("tramo")
