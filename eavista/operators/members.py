"""Students of a project, and which of them its JSON list names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eavista.functions.json_text import json_string_members
from eavista.functions.scalars import canonical_id, unsigned_cast
from eavista.operators.attributes import attribute_rows, first
from eavista.operators.chosen import Chosen
from eavista.operators.references import ROLES
from eavista.sources.tables import Tables

MEMBERS = (ROLES["integrante_1"], ROLES["integrante_2"])
# Copies of one counted row that one row of the next step stands for.
COPIES_PER_SLICE = 1_000_000
LIST_ATTRIBUTE = first("beneficiarios_icfes")


def member_counts(tables: Tables, chosen: Chosen | None = None) -> DataFrame:
    """(project, user id, copias): every member value, equal ones counted together.

    Counting before the shuffle keeps a project with many equal values small; the
    key has both ids, so one with many different members spreads. Where projects are
    ``chosen``, rows of others are not counted.
    """
    values = tables.valores_campos
    rows = attribute_rows(values if chosen is None else chosen.rows(values, "solicitud_id"), tables.campos, *MEMBERS)
    return (
        rows.select("solicitud_id", unsigned_cast(F.col("valor")).alias("usuario_id"))
        .filter(F.col("usuario_id").isNotNull())
        .groupBy("solicitud_id", "usuario_id")
        .agg(F.count(F.lit(1)).alias("copias"))
    )


def repeat_copies(frame: DataFrame) -> DataFrame:
    """Undo the counting: one row per copy, made in slices that are dealt out to many tasks."""
    last = F.floor((F.col("copias") - 1) / COPIES_PER_SLICE)
    sliced = frame.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("slice"))
    left = F.least(F.lit(COPIES_PER_SLICE).cast("bigint"), F.col("copias") - F.col("slice") * COPIES_PER_SLICE)
    dealt = sliced.withColumn("copias", left).repartition("solicitud_id", "usuario_id", "slice")
    repeats = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copias"))).alias("copia")
    return dealt.select("*", repeats).drop("copias", "copia", "slice")


def listed_members(tables: Tables) -> DataFrame:
    """Distinct (project, user id) that the project's JSON lists name."""
    rows = attribute_rows(tables.valores_campos, tables.campos, LIST_ATTRIBUTE)
    named = rows.select("solicitud_id", F.explode(json_string_members("valor")).alias("texto"))
    return (
        named.select("solicitud_id", canonical_id(F.col("texto")).alias("usuario_id"))
        .filter(F.col("usuario_id").isNotNull())
        .distinct()
    )


def beneficiaries(tables: Tables) -> DataFrame:
    """Distinct (project, user id) that are members and listed.

    The theta join on JSON membership becomes an equi-join on both ids, on the
    partitioning that the two aggregations already have.
    """
    members = member_counts(tables).select("solicitud_id", "usuario_id")
    return members.join(listed_members(tables), ["solicitud_id", "usuario_id"])
