"""From long attribute values to one row per project."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, functions as F

from eavista.functions.scalars import unsigned_cast


# Attributes that one bigint has a bit for; more take further words.
WORD = 62
# Ids that go into one bigint together with an attribute id; larger ones take a decimal.
SMALL = 2**32 - 1
# What an attribute id counts in that decimal.
ID_SPAN = 2**64


@dataclass(frozen=True)
class Attribute:
    """An attribute by name, within one phase or in any, and how to reduce its values.

    ``greatest`` is the largest text. ``first`` is the value with the smallest
    (attribute id, text), NULL text first. ``reference`` is the id that a value is cast to,
    of the smallest (attribute id, id), NULL first.
    """

    name: str
    phase: int | None
    reduce: str

    def matches(self) -> Column:
        named = F.col("name") == self.name
        return named if self.phase is None else named & (F.col("tipo_solicitud_id") == self.phase)


def greatest(name: str, phase: int | None = None) -> Attribute:
    return Attribute(name, phase, "greatest")


def first(name: str, phase: int | None = None) -> Attribute:
    return Attribute(name, phase, "first")


def reference(name: str, phase: int | None = None) -> Attribute:
    return Attribute(name, phase, "reference")


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def attribute_rows(values: DataFrame, campos: DataFrame, *attributes: Attribute) -> DataFrame:
    """The long value rows of some attributes, or of every known attribute if none is named."""
    if attributes:
        campos = campos.filter(any_of([attribute.matches() for attribute in attributes]))
    catalog = campos.select(F.col("id").alias("campo_id"), "name", "tipo_solicitud_id")
    return values.join(catalog, "campo_id")


def pivot_attributes(
    values: DataFrame, campos: DataFrame, attributes: Mapping[str, Attribute]
) -> DataFrame:
    """One row per project that has any wanted value, one column per attribute.

    The attribute conditions are evaluated on the catalog, which gives each
    attribute id masks of the columns it feeds: a value row carries a number or a
    few through the aggregation, and values of other attributes are never read from
    a layout by attribute. References are numbers in attribute order and reduce by
    hash; only texts need a sort. Aggregation is partial before the single shuffle by
    project, which also keeps a project with very many values from landing in one
    task unreduced.
    """
    specs = list(attributes.values())
    conditions = [spec.matches() for spec in specs]
    masks = []
    for start in range(0, len(specs), WORD):
        bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions[start : start + WORD])]
        masks.append(reduce(add, bits).cast("bigint").alias(f"mask_{start // WORD}"))
    catalog = campos.filter(any_of(conditions)).select(F.col("id").alias("campo_id"), *masks)
    rows = values.join(catalog, "campo_id")
    refers = [i for i, spec in enumerate(specs) if spec.reduce == "reference"]
    if refers:
        # NULL before every id.
        number = F.coalesce(unsigned_cast(F.col("valor")), F.lit(-1).cast("bigint"))
        rows = rows.withColumn("numero", F.when(any_of([_feeds(i) for i in refers]), number))
    reduced = []
    for i, (column, spec) in enumerate(attributes.items()):
        reduced += [c.alias(name) for name, c in _reduced(column, spec, _feeds(i)).items()]
    wide = rows.groupBy("solicitud_id").agg(*reduced)
    if not refers:
        return wide
    return wide.select("solicitud_id", *[
        _id_of(column).alias(column) if spec.reduce == "reference" else column for column, spec in attributes.items()
    ])


def _feeds(column: int) -> Column:
    """Whether a value row's attribute feeds that column."""
    return F.col(f"mask_{column // WORD}").bitwiseAND(F.lit(1 << column % WORD)) != 0


def _id_of(column: str) -> Column:
    """The id of the least (attribute id, id) in the two forms; NULL where it is NULL or there is none."""
    small, large = F.col(f"{column} s"), F.col(f"{column} l")
    low = small.bitwiseAND(F.lit(2**32 - 1))
    whole = F.shiftright(small, 32).cast("decimal(38,0)") * F.lit(Decimal(ID_SPAN))
    both = F.least(whole + low.cast("decimal(20,0)"), large)
    least = F.nullif(F.pmod(both, F.lit(Decimal(ID_SPAN))), F.lit(0)) - F.lit(1)
    return F.when(large.isNull(), F.nullif(low, F.lit(0)) - 1).otherwise(least.cast("bigint"))


def count_values(
    values: DataFrame, campos: DataFrame, column: str, phase: int | None = None
) -> DataFrame:
    """(project, ``column``): its number of values of known attributes, of one phase or of any.

    Apart from the pivot because it needs every attribute but no text: it reads
    the ids only and sums them up by hash.
    """
    if phase is not None:
        campos = campos.filter(F.col("tipo_solicitud_id") == phase)
    known = values.join(campos.select(F.col("id").alias("campo_id")), "campo_id")
    return known.groupBy("solicitud_id").agg(F.count(F.lit(1)).alias(column))


def _reduced(column: str, spec: Attribute, wanted: Column) -> dict[str, Column]:
    if spec.reduce == "greatest":
        return {column: F.max(F.when(wanted, F.col("valor")))}
    if spec.reduce == "first":
        return {column: F.min(F.when(wanted, F.struct("campo_id", "valor"))).getField("valor")}
    # (attribute id, id) as one number in the same order, ids from 1, 0 for NULL.
    attribute, number = F.col("campo_id").cast("bigint"), F.col("numero")
    small = F.shiftleft(attribute, 32).bitwiseOR(number + 1)
    large = attribute.cast("decimal(38,0)") * F.lit(Decimal(ID_SPAN)) + number.cast("decimal(20,0)") + F.lit(1)
    return {
        f"{column} s": F.min(F.when(wanted & (number < SMALL), small)),
        f"{column} l": F.min(F.when(wanted & (number >= SMALL), large.cast("decimal(38,0)"))),
    }
