"""Exam beneficiaries: members that their project's JSON list names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eavista.functions.scalars import preferred_text
from eavista.operators.attributes import greatest
from eavista.operators.filters import live
from eavista.operators.members import beneficiaries
from eavista.operators.references import project_frame
from eavista.operators.skew import spread_join
from eavista.sources.tables import Tables

# The exported columns as (label, key), in order.
EXPORT = [
    ("Programa", "programa"),
    ("Título", "titulo"),
    ("Modalidad", "modalidad"),
    ("Estudiante", "estudiante"),
    ("ID", "id_estudiante"),
    ("Director", "director"),
    ("Evaluador", "evaluador"),
    ("Estado", "estado"),
    ("Observaciones", "observaciones"),
]
TITLE = "Beneficiarios TyT / PRO Sistemas"

# The keys that make two rows one; there is no project among them.
KEYS = [
    "usuario_id", "name", "nro_documento", "nivel", "modalidad",
    "director_name", "evaluador_name", "tipo", "titulo_idea",
]


def beneficiary_report(
    tables: Tables, spread: bool = True, broadcast_people: bool | None = None
) -> DataFrame:
    """Beneficiaries of live projects of any type, by programme and name."""
    types = tables.tipos_solicitudes.select(
        F.col("id").alias("tipo_solicitud_id"), F.col("nombre").alias("tipo")
    )
    typed = live(tables.solicitudes).join(types, "tipo_solicitud_id").select("id", "tipo")
    projects = project_frame(
        tables,
        typed,
        attributes={"titulo_propio": greatest("titulo"), "codigo": greatest("codigo_modalidad")},
        levels=True,
        modalities=True,
        people={"director": ("name",), "evaluador": ("name",)},
        idea_title=True,
        broadcast_people=broadcast_people,
    ).select(
        F.col("id").alias("solicitud_id"), "tipo", "nivel", "modalidad", "director_name",
        "evaluador_name", "titulo_idea", "titulo_propio", "codigo",
    )
    named = beneficiaries(tables)
    if spread:
        rows = spread_join(named, projects, "solicitud_id", spread_on="usuario_id")
    else:
        rows = named.join(projects, "solicitud_id")
    users = tables.users.select(F.col("id").alias("usuario_id"), "name", "nro_documento")
    grouped = (
        rows.join(users, "usuario_id")
        .groupBy(*KEYS)
        .agg(F.max("titulo_propio").alias("titulo_propio"), F.max("codigo").alias("codigo"))
    )
    return grouped.orderBy("nivel", "name", *[k for k in KEYS if k not in ("nivel", "name")]).select(
        F.col("nivel").alias("programa"),
        preferred_text(F.col("titulo_propio"), F.col("titulo_idea")).alias("titulo"),
        F.concat("modalidad", F.lit(" - "), "codigo").alias("modalidad"),
        F.col("name").alias("estudiante"),
        F.col("nro_documento").alias("id_estudiante"),
        F.col("director_name").alias("director"),
        F.col("evaluador_name").alias("evaluador"),
        F.col("tipo").alias("estado"),
        F.lit(None).cast("string").alias("observaciones"),
    )
