"""Subtotal and grand-total rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from eavista.operators.layout import quoted


def total_row(frame: DataFrame, label_column: str, label: str, sums: Sequence[str]) -> DataFrame:
    """One row of sums over the whole frame; sums of nothing are 0."""
    kinds = {field.name: field.dataType for field in frame.schema}
    added = {c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums}
    row = frame.agg(*added.values())
    return row.select(*[
        F.lit(label).alias(c) if c == label_column
        else quoted(c) if c in added
        else F.lit(None).cast(kinds[c]).alias(c)
        for c in frame.columns
    ])


def with_total(frame: DataFrame, label_column: str, label: str, sums: Sequence[str]) -> DataFrame:
    """The rows and a last one, marked ``es_total``."""
    detail = frame.withColumn("es_total", F.lit(False))
    total = total_row(frame, label_column, label, sums).withColumn("es_total", F.lit(True))
    return detail.unionByName(total)


def nested_rows(frame: DataFrame, key: str, sort_by: str, tie: str) -> DataFrame:
    """One row per ``key`` with its rows as an array, largest ``sort_by`` first."""
    rest = [c for c in frame.columns if c != key]
    ranked = F.struct(
        (-F.col(sort_by)).alias("menos"), F.col(tie).alias("empate"), F.struct(*rest).alias("fila")
    )
    ordered = F.sort_array(F.collect_list(ranked))
    return frame.groupBy(key).agg(F.transform(ordered, lambda r: r["fila"]).alias("filas"))
