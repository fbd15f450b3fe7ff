"""Positions in a sorted order without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eavista.sources.shared import written


def in_ranges(frame: DataFrame, order: list[Column]) -> DataFrame:
    """The rows in global order, written: ``tramo`` is the range and ``orden`` rises within it.

    Ranges are as many as the session's shuffle partitions, cut where Spark's own sample
    of the order says; any cuts give the same positions.
    """
    ranges = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranges.withColumns({"tramo": F.spark_partition_id(), "orden": F.monotonically_increasing_id()}))


def counted_before(ranges: DataFrame, *group: str) -> DataFrame:
    """(group, tramo, ``antes``): what to add to ``orden`` for the 1-based position within the group.

    At most one row per group and range.
    """
    sizes = ranges.groupBy(*group, "tramo").agg(F.count(F.lit(1)).alias("n"), F.min("orden").alias("primero"))
    below = Window.partitionBy(*group).orderBy("tramo").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(below), F.lit(0))
    return sizes.select(*group, "tramo", (before - F.col("primero") + 1).alias("antes"))


def with_position(frame: DataFrame, group: str, name: str) -> DataFrame:
    """Adds ``fila``: the 1-based position of ``name`` within ``group``, NULL first.

    Equal names have neighbouring positions in no stated order. A group that holds most
    rows takes as many ranges as it needs.
    """
    ranges = in_ranges(frame, [F.col(group), F.col(name).asc_nulls_first()])
    placed = ranges.join(counted_before(ranges, group), [group, "tramo"])
    return placed.withColumn("fila", F.col("antes") + F.col("orden")).drop("tramo", "orden", "antes")
