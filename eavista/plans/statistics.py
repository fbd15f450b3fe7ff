"""Committee statistics: by semester, by approval state and by modality.

All three sections add up one table of counts, ``committee_cells``, whose size
depends on the periods and modalities and not on the projects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eavista.functions.scalars import (
    active_text,
    matching_text,
    received_text,
    zero_if_null,
)
from eavista.operators.attributes import greatest
from eavista.operators.filters import projects_of
from eavista.operators.references import project_frame
from eavista.operators.totals import with_total
from eavista.plans.general import FORMAL, participants
from eavista.sources.tables import Tables

# States and programme levels with a meaning here.
CLOSED = ["Rechazada", "Finalizado"]
APPROVED = ["Fase 4", "Fase 5", "Finalizado"]
REJECTED = "Rechazada"
TECHNOLOGY, ENGINEERING = 1, 2

# Titles and (label, key) columns, with the header above them where there is one.
TITLE = "Estadísticas a presentar en comité curricular"
SECTION_TITLES = {
    "por_semestre": "Resumen por semestre",
    "aprobacion": "Aprobación de propuestas por semestre",
    "por_modalidad": "Distribución por modalidad y programa",
}
SECTION_LABELS = {
    "por_semestre": [
        ("Semestre", "periodo"),
        ("Proyectos recibidos", "proyectos_recibidos"),
        ("Proyectos Vigentes", "proyectos_vigentes"),
        ("No. Estudiantes Proyectos Vigentes", "estudiantes_vigentes"),
        ("Es total", "es_total"),
    ],
    "aprobacion": [
        ("Semestre", "periodo"),
        ("Proyectos recibidos", "recibidos"),
        ("Propuestas aprobadas", "aprobados"),
        ("Propuestas pendientes por aprobar", "pendientes"),
    ],
    "por_modalidad": [
        ("Modalidad", "modalidad"),
        ("Cantidad Proyectos", "proyectos_tecnologico", "Tecnología en Desarrollo de Sistemas Informáticos"),
        ("No. Estudiantes", "estudiantes_tecnologico", "Tecnología en Desarrollo de Sistemas Informáticos"),
        ("Cantidad Proyectos", "proyectos_profesional", "Ingeniería de Sistemas"),
        ("No. Estudiantes", "estudiantes_profesional", "Ingeniería de Sistemas"),
        ("Es total", "es_total"),
    ],
}


def holds(condition: Column) -> Column:
    """Three-valued condition to a flag: unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def formal_projects(tables: Tables, **wanted) -> DataFrame:
    """Live formal projects with the period and the number of values of their phase."""
    return project_frame(
        tables,
        projects_of(tables.solicitudes, FORMAL).select("id", "estado"),
        attributes={"periodo": greatest("periodo", FORMAL)},
        counts={"valores_fase": FORMAL},
        **wanted,
    )


def committee_cells(tables: Tables, broadcast_people: bool | None = None) -> DataFrame:
    """Projects and students per period, modality, level and state flags."""
    projects = formal_projects(
        tables,
        levels=True,
        modalities=True,
        people={"integrante_2": ()},
        broadcast_people=broadcast_people,
    )
    state = F.col("estado")
    keyed = projects.select(
        holds(F.col("valores_fase") > 0).alias("con_valores"),
        "periodo",
        "modalidad",
        F.when(F.col("nivel_ok").isin(TECHNOLOGY, ENGINEERING), F.col("nivel_ok")).alias("nivel"),
        holds(~state.isin(CLOSED)).alias("vigente"),
        holds(state.isin(APPROVED)).alias("aprobado"),
        holds(~state.isin([*APPROVED, REJECTED])).alias("pendiente"),
        participants().alias("estudiantes"),
    )
    keys = ["con_valores", "periodo", "modalidad", "nivel", "vigente", "aprobado", "pendiente"]
    return keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("proyectos"), F.sum("estudiantes").alias("estudiantes")
    )


def _sum_if(condition: Column, amount: str) -> Column:
    return F.sum(F.when(condition, F.col(amount)).otherwise(0))


def by_semester(cells: DataFrame) -> DataFrame:
    active, level = F.col("vigente"), F.col("nivel")
    return (
        cells.filter("con_valores")
        .groupBy("periodo")
        .agg(
            F.sum("proyectos").alias("proyectos_recibidos"),
            _sum_if(active, "proyectos").alias("proyectos_vigentes"),
            _sum_if(active & (level == TECHNOLOGY), "proyectos").alias("vigentes_tecnologico"),
            _sum_if(active & (level == ENGINEERING), "proyectos").alias("vigentes_profesional"),
            _sum_if(active, "estudiantes").alias("estudiantes_vigentes"),
        )
        .orderBy("periodo")
    )


def by_approval(cells: DataFrame) -> DataFrame:
    approved, pending = F.col("aprobado"), F.col("pendiente")
    return (
        cells.filter("con_valores")
        .groupBy("periodo")
        .agg(
            F.sum("proyectos").alias("recibidos"),
            F.sum("estudiantes").alias("recibidos_estudiantes"),
            _sum_if(approved, "proyectos").alias("aprobados"),
            _sum_if(approved, "estudiantes").alias("aprobados_estudiantes"),
            _sum_if(pending, "proyectos").alias("pendientes"),
            _sum_if(pending, "estudiantes").alias("pendientes_estudiantes"),
        )
        .orderBy("periodo")
    )


def by_modality(cells: DataFrame) -> DataFrame:
    """Projects without values of their phase count here too."""
    technology, engineering = F.col("nivel") == TECHNOLOGY, F.col("nivel") == ENGINEERING
    return (
        cells.groupBy("modalidad")
        .agg(
            _sum_if(technology, "proyectos").alias("proyectos_tecnologico"),
            _sum_if(technology, "estudiantes").alias("estudiantes_tecnologico"),
            _sum_if(engineering, "proyectos").alias("proyectos_profesional"),
            _sum_if(engineering, "estudiantes").alias("estudiantes_profesional"),
        )
        .orderBy(F.col("proyectos_tecnologico").desc(), "modalidad")
    )


def semester_total(cells: DataFrame) -> DataFrame:
    numbers = by_semester(cells).select(
        "periodo", "proyectos_recibidos", "proyectos_vigentes", "estudiantes_vigentes"
    )
    return with_total(numbers, "periodo", "TOTAL", numbers.columns[1:])


def modality_total(cells: DataFrame) -> DataFrame:
    numbers = by_modality(cells)
    return with_total(numbers, "modalidad", "Total", numbers.columns[1:])


def semester_text(cells: DataFrame) -> DataFrame:
    """The semester section as shown, its totals row last."""
    shown = by_semester(cells).select(
        "periodo",
        "proyectos_recibidos",
        active_text(
            F.col("proyectos_vigentes"), F.col("vigentes_tecnologico"), F.col("vigentes_profesional")
        ).alias("proyectos_vigentes"),
        "estudiantes_vigentes",
        F.lit(False).alias("es_total"),
    )
    total = semester_total(cells).filter("es_total")
    return shown.unionByName(
        total.withColumn("proyectos_vigentes", F.col("proyectos_vigentes").cast("string"))
    ).orderBy("es_total", "periodo")


def approval_text(cells: DataFrame) -> DataFrame:
    pairs = [("aprobados", matching_text), ("pendientes", matching_text)]
    return by_approval(cells).select(
        "periodo",
        received_text(F.col("recibidos"), F.col("recibidos_estudiantes")).alias("recibidos"),
        *[text(F.col(c), F.col(f"{c}_estudiantes")).alias(c) for c, text in pairs],
    )


def modality_rows(cells: DataFrame) -> DataFrame:
    numbers = modality_total(cells)
    counts = [c for c in numbers.columns if c not in ("modalidad", "es_total")]
    return numbers.withColumns({c: zero_if_null(F.col(c)) for c in counts}).orderBy(
        "es_total", F.col("proyectos_tecnologico").desc(), "modalidad"
    )
