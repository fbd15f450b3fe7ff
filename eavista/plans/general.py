"""General report: one row per live formal project."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eavista.functions.json_text import json_length
from eavista.functions.scalars import preferred_text, zero_if_null
from eavista.operators.attributes import greatest
from eavista.operators.chosen import choose
from eavista.operators.filters import optional_filters, projects_of
from eavista.operators.milestones import first_milestones, with_deadlines
from eavista.operators.references import project_frame
from eavista.sources.tables import Tables

FORMAL = 2
CONTACT = ("name", "nro_documento", "nro_celular", "email")
PEOPLE = {
    "director": ("name",),
    "evaluador": ("name",),
    "codirector": ("name",),
    "integrante_1": CONTACT,
    "integrante_2": CONTACT,
}
ATTRIBUTES = {
    "periodo": greatest("periodo"),
    "consecutivo": greatest("codigo_modalidad"),
    "objetivo": greatest("objetivo"),
    "observaciones": greatest("descripcion"),
    "lista_beneficiarios": greatest("beneficiarios_icfes"),
    "titulo_propio": greatest("titulo"),
}

# The exported columns as (label, key), in order.
EXPORT = [
    ("Periodo Académico Tramitado", "periodo"),
    ("Programa académico", "nivel"),
    ("Consecutivo de proyecto", "consecutivo"),
    ("Nombre de la propuesta", "titulo"),
    ("Modalidad", "modalidad"),
    ("Observaciones", "observaciones"),
    ("Nombre del director", "director"),
    ("Docente evaluador", "evaluador"),
    ("Beneficiaros TyT / PRO", "beneficiarios_icfes"),
    ("Nombre y Apellidos", "nombre_est_1"),
    ("Documento de identidad", "documento_est_1"),
    ("No. de Celular", "celular_est_1"),
    ("Correo Electrónico", "correo_est_1"),
    ("Nombres y Apellidos Autor 2", "nombre_est_2"),
    ("Documento de Identidad 2", "documento_est_2"),
    ("Celular del autor 2", "celular_est_2"),
    ("Correo del autor 2", "correo_est_2"),
    ("Participantes", "participantes"),
    ("APROBACIÓN PROPUESTA F-DC-124 - F-DC-127", "acta_aprobacion_propuesta"),
    ("(Fecha de aprobación por parte de evaluador, número de Acta y fecha de acta)", "fecha_aprobacion_acta"),
    ("FECHA VENCIMIENTO", "fecha_maxima"),
    ("APROBACIÓN PROPUESTA F-DC-125 - F-DC-128", "acta_aprobacion_final"),
    ("(Fecha de aprobación por parte de evaluador, número de Acta y fecha de acta)", "fecha_aprobacion_final"),
    ("Prórroga", "acta_fecha_prorroga"),
    ("Fecha Prórroga", "fecha_prorroga"),
    ("Enlace Repositorio", "link_repo"),
    ("Mínimo tiempo", "fecha_minima"),
]
TITLE = "Reporte General TG Sistemas"


def participants(present: str = "integrante_2_ok"):
    """2 when the second member is a known user, else 1."""
    return F.when(F.col(present).isNotNull(), 2).otherwise(1)


def general_report(
    tables: Tables,
    estado: str | None = None,
    fecha_inicio: str | None = None,
    fecha_fin: str | None = None,
    broadcast_people: bool | None = None,
) -> DataFrame:
    """All columns, newest project first; equal dates by id, so a hot date still splits.

    A filter works on everything keyed by project: values, milestones, links and the
    titles of linked ideas are those of the chosen projects before they are aggregated.
    """
    filters = (estado, fecha_inicio, fecha_fin)
    projects = optional_filters(projects_of(tables.solicitudes, FORMAL), *filters).select("id", "created_at")
    chosen = choose(projects) if any(filters) else None
    actas = tables.actas if chosen is None else chosen.rows(tables.actas, "proyecto_id")
    frame = with_deadlines(
        project_frame(
            tables,
            projects,
            attributes=ATTRIBUTES,
            levels=True,
            modalities=True,
            people=PEOPLE,
            idea_title=True,
            beside=[first_milestones(actas)],
            broadcast_people=broadcast_people,
            chosen=chosen,
        )
    )
    absent = F.lit(None).cast("string")
    return frame.orderBy(F.col("created_at").desc(), "id").select(
        "id",
        "periodo",
        "consecutivo",
        "objetivo",
        "observaciones",
        zero_if_null(json_length("lista_beneficiarios")).alias("beneficiarios_icfes"),
        preferred_text(F.col("titulo_propio"), F.col("titulo_idea")).alias("titulo"),
        "nivel",
        "modalidad",
        F.col("director_name").alias("director"),
        F.col("evaluador_name").alias("evaluador"),
        F.col("codirector_name").alias("codirector"),
        *_contact(1),
        *_contact(2),
        participants().alias("participantes"),
        F.col("aprobacion.numero").alias("acta_aprobacion_propuesta"),
        F.col("aprobacion.fecha").alias("fecha_aprobacion_acta"),
        F.col("final.numero").alias("acta_aprobacion_final"),
        F.col("final.fecha").alias("fecha_aprobacion_final"),
        F.col("prorroga.numero").alias("acta_fecha_prorroga"),
        F.col("prorroga.fecha").alias("fecha_prorroga"),
        "fecha_minima",
        "fecha_maxima",
        absent.alias("link_repo"),
        absent.alias("link_repo_exento"),
        absent.alias("documento_est_1_alt"),
        absent.alias("documento_est_2_alt"),
    )


def _contact(number: int) -> list:
    shown = ("nombre", "documento", "celular", "correo")
    return [
        F.col(f"integrante_{number}_{field}").alias(f"{name}_est_{number}")
        for name, field in zip(shown, CONTACT)
    ]
