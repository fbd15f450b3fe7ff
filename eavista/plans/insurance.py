"""Insurance list: one row per member of a live project of the approved phase."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eavista.operators.chosen import choose
from eavista.operators.filters import projects_of
from eavista.operators.members import member_counts, repeat_copies
from eavista.operators.references import project_frame
from eavista.operators.skew import spread_join
from eavista.sources.tables import Tables

APPROVED = 5

# The exported columns as (label, key), in order.
EXPORT = [
    ("APELLIDOS Y NOMBRES", "apellidos_nombres"),
    ("No. DE DOCUMENTO", "nro_documento"),
    ("PROGRAMA ACADÉMICO", "programa_academico"),
    ("SEDE", "sede"),
]
TITLE = "Estudiantes propuestas aprobadas para afiliación ARL"
CAMPUS = "PRINCIPAL"


def insurance_report(tables: Tables, spread: bool = True) -> DataFrame:
    """Members by name; ties by document and project, so a hot name still splits.

    Approved projects are few of all: only their values are read into the aggregations.
    """
    approved = projects_of(tables.solicitudes, APPROVED).select("id")
    chosen = choose(approved)
    projects = project_frame(tables, approved, levels=True, chosen=chosen).select(
        F.col("id").alias("solicitud_id"), "nivel"
    )
    members = member_counts(tables, chosen)
    if spread:
        rows = spread_join(members, projects, "solicitud_id", spread_on="usuario_id")
    else:
        rows = members.join(projects, "solicitud_id")
    users = tables.users.select(F.col("id").alias("usuario_id"), "name", "nro_documento")
    return (
        repeat_copies(rows.join(users, "usuario_id"))
        .orderBy("name", "nro_documento", "solicitud_id")
        .select(
            F.col("name").alias("apellidos_nombres"),
            "nro_documento",
            F.col("nivel").alias("programa_academico"),
            F.lit(CAMPUS).alias("sede"),
        )
    )
