"""One Spark query per operator and report, over the derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from eavista.functions.json_text import json_length, json_string_members
from eavista.functions.scalars import preferred_text, unsigned_cast, zero_if_null
from eavista.operators.attributes import attribute_rows, greatest
from eavista.operators.filters import projects_of
from eavista.operators.layout import column_widths, labelled
from eavista.operators.members import LIST_ATTRIBUTE, beneficiaries, member_counts, repeat_copies
from eavista.operators.milestones import KINDS, first_milestones, with_deadlines
from eavista.operators.references import ROLES, project_frame
from eavista.plans import general, insurance, modality, professors, statistics
from eavista.plans.beneficiaries import beneficiary_report
from eavista.plans.registry import export_report, run_report
from eavista.sources.shared import shared_folder
from eavista.sources.sink import POSITION, read_report
from eavista.sources.tables import Tables

Query = Callable[[Tables], DataFrame]


def formal(t: Tables, *columns: str) -> DataFrame:
    return projects_of(t.solicitudes, general.FORMAL).select("id", *columns)


def active_projects(t: Tables) -> DataFrame:
    return formal(t, "estado", "created_at")


def eav_named(t: Tables) -> DataFrame:
    rows = attribute_rows(t.valores_campos, t.campos)
    return rows.select(
        "solicitud_id", "campo_id", "name", F.col("tipo_solicitud_id").alias("fase"), "valor"
    )


def eav_wide(t: Tables) -> DataFrame:
    return project_frame(t, formal(t), attributes=general.ATTRIBUTES)


def unsigned(t: Tables) -> DataFrame:
    return t.valores_campos.withColumn("numero", unsigned_cast(F.col("valor")))


def json_len(t: Tables) -> DataFrame:
    rows = attribute_rows(t.valores_campos, t.campos, LIST_ATTRIBUTE)
    length = zero_if_null(json_length("valor"))
    return rows.select("solicitud_id", "campo_id", "valor", length.alias("largo"))


def json_shapes(t: Tables) -> DataFrame:
    """Lengths and members of nested lists, objects, scalars and malformed text made from ids."""
    k = F.col("id").cast("string")
    texts = [
        F.concat(F.lit('["'), k, F.lit('",["'), k, F.lit('x"]]')),
        F.concat(F.lit('{"a":"'), k, F.lit('","b":["'), k, F.lit('"],"a":1}')),
        F.concat(F.lit('"'), k, F.lit('"')),
        k,
        F.concat(F.lit('["'), k, F.lit('"')),
        F.concat(F.lit(' [{"a":"'), k, F.lit('"} , "'), k, F.lit('"]\n')),
        F.concat(F.lit('[[["'), k, F.lit('"],{}],'), k, F.lit("]")),
        F.lit(""),
        F.lit(None).cast("string"),
        F.concat(F.lit('["'), k, F.lit('"] 1')),
    ]
    shape = F.pmod("id", F.lit(len(texts)))
    rows = t.solicitudes.select("id", F.element_at(F.array(*texts), (shape + 1).cast("int")).alias("texto"))
    members = F.coalesce(F.array_contains(json_string_members("texto"), F.col("id").cast("string")), F.lit(False))
    return rows.select("id", "texto", json_length("texto").alias("largo"), members.alias("contiene"))


def level_lookup(t: Tables) -> DataFrame:
    return project_frame(t, formal(t), levels=True).select("id", "nivel_ref", "nivel")


def modality_lookup(t: Tables) -> DataFrame:
    return project_frame(t, formal(t), modalities=True).select("id", "modalidad_ref", "modalidad")


def director_lookup(t: Tables) -> DataFrame:
    return project_frame(t, formal(t), people={"director": ("name",)}).select(
        "id", F.col("director_ok").alias("director_id"), F.col("director_name").alias("director")
    )


def idea_lookup(t: Tables) -> DataFrame:
    return project_frame(t, formal(t), idea_title=True)


def people_roles(t: Tables) -> DataFrame:
    frame = project_frame(t, formal(t), people={role: ("name",) for role in ROLES})
    return frame.select("id", *[F.col(f"{role}_name").alias(role) for role in ROLES])


def project_period(t: Tables) -> DataFrame:
    return statistics.formal_projects(t).filter(F.col("valores_fase") > 0).select("id", "periodo")


def participants(t: Tables) -> DataFrame:
    frame = project_frame(t, formal(t), people={"integrante_2": ()})
    return frame.select("id", general.participants().alias("participantes"))


def title_fallback(t: Tables) -> DataFrame:
    frame = project_frame(
        t, formal(t), attributes={"titulo_propio": greatest("titulo")}, idea_title=True
    )
    title = preferred_text(F.col("titulo_propio"), F.col("titulo_idea"))
    return frame.select("id", "titulo_propio", "titulo_idea", title.alias("titulo"))


def milestones(t: Tables) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(text).alias("descripcion"), F.col(kind).alias("acta"))
        for kind, text in KINDS.items()
    ])
    return (
        first_milestones(t.actas)
        .select("solicitud_id", F.explode(entries).alias("h"))
        .filter(F.col("h.acta").isNotNull())
        .select(
            "solicitud_id", "h.descripcion", F.col("h.acta.id").alias("acta_id"),
            "h.acta.numero", "h.acta.fecha",
        )
    )


def deadlines(t: Tables) -> DataFrame:
    frame = with_deadlines(project_frame(t, formal(t), beside=[first_milestones(t.actas)]))
    return frame.select(
        "id",
        F.col("aprobacion.fecha").alias("fecha_aprobacion_acta"),
        F.col("prorroga.fecha").alias("fecha_prorroga"),
        "fecha_minima",
        "fecha_maxima",
    )


def members(t: Tables) -> DataFrame:
    users = t.users.select(F.col("id").alias("usuario_id"), "name", "nro_documento")
    return repeat_copies(member_counts(t).join(users, "usuario_id")).select(
        "solicitud_id", "usuario_id", "name", "nro_documento"
    )


def listed(t: Tables) -> DataFrame:
    known = t.users.select(F.col("id").alias("usuario_id"))
    return beneficiaries(t).join(known, "usuario_id").select("solicitud_id", "usuario_id")


def general_filtered(t: Tables) -> DataFrame:
    return general.general_report(
        t, estado="Fase 4", fecha_inicio="1996-03-01", fecha_fin="2000-09-30"
    )


def general_export(t: Tables) -> DataFrame:
    return labelled(general.general_report(t), general.EXPORT)


def section(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda t: build(statistics.committee_cells(t))


def stats_text(t: Tables) -> DataFrame:
    cells = statistics.committee_cells(t)

    def shown(frame: DataFrame, name: str, *columns: str) -> DataFrame:
        texts = [F.col(c).cast("string") for c in columns]
        return frame.select(
            F.lit(name).alias("seccion"), "periodo",
            *[text.alias(alias) for text, alias in zip(texts, ("recibidos", "principales", "otros"))],
        )

    semesters = shown(
        statistics.semester_text(cells), "por_semestre",
        "proyectos_recibidos", "proyectos_vigentes", "estudiantes_vigentes",
    )
    approvals = shown(
        statistics.approval_text(cells), "aprobacion", "recibidos", "aprobados", "pendientes"
    )
    return semesters.unionByName(approvals)


def workload_of(name: str) -> Query:
    return lambda t: professors.long_section(professors.workload(t, (name,)), name)


def professor_section(section: str, **form) -> Query:
    """A section of the professor report as the registry gives it."""
    return lambda t: run_report(t.actas.sparkSession, "dinamica_profesores_report", t, **form)[section]


def modality_nested(t: Tables) -> DataFrame:
    rows = modality.nested(modality.dynamics(t))
    return rows.select("periodo", F.to_json("filas", {"ignoreNullFields": "false"}).alias("filas"))


def widths(t: Tables) -> DataFrame:
    return column_widths(general_export(t))


def sink_roundtrip(t: Tables) -> DataFrame:
    """Write a report of three sections, read the complete run back, and show every cell with its place."""
    spark = t.actas.sparkSession
    base, run = f"{shared_folder(spark)}/reports", uuid.uuid4().hex
    export_report(spark, "estadisticas_report", t, base, run)
    out = None
    for name, frame in read_report(spark, base, "estadisticas_report", run, position=True).items():
        cells = frame.drop("escrito").withColumnsRenamed({"seccion": "de", POSITION: "fila"})
        values = [F.col(c).cast("string").alias(c) for c in cells.columns if c != "fila"]
        part = cells.select("fila", *values).unpivot("fila", cells.columns[1:], "columna", "valor")
        part = part.select(F.lit(name).alias("seccion"), *part.columns)
        out = part if out is None else out.unionByName(part)
    return out


def labelled_moments(t: Tables) -> DataFrame:
    """A moment as text, a key that no column has, and labels that repeat."""
    columns = [("Proyecto", "id"), ("Fecha", "created_at"), ("Fecha", "deleted_at"), ("Enlace", "no_hay"), ("Estado", "estado")]
    return labelled(t.solicitudes, columns)


QUERIES: dict[str, Query] = {
    "active_projects": active_projects,
    "eav_named": eav_named,
    "eav_wide": eav_wide,
    "unsigned_cast": unsigned,
    "json_len": json_len,
    "json_shapes": json_shapes,
    "ref_lookup_level": level_lookup,
    "ref_lookup_modality": modality_lookup,
    "ref_lookup_director": director_lookup,
    "ref_lookup_idea": idea_lookup,
    "people_roles": people_roles,
    "project_period": project_period,
    "participants": participants,
    "title_fallback": title_fallback,
    "milestones": milestones,
    "deadlines": deadlines,
    "members": members,
    "beneficiaries": listed,
    "general_report": general.general_report,
    "general_filtered": general_filtered,
    "general_export": general_export,
    "arl_report": insurance.insurance_report,
    "tyt_report": beneficiary_report,
    "stats_semester": section(statistics.by_semester),
    "stats_approval": section(statistics.by_approval),
    "stats_modality": section(statistics.by_modality),
    "stats_semester_total": section(statistics.semester_total),
    "stats_modality_total": section(statistics.modality_total),
    "stats_text": stats_text,
    "period_list": professors.period_list,
    "directores_long": workload_of("director"),
    "evaluadores_long": workload_of("evaluador"),
    "directores_matrix": professor_section("directores", ancho=8),
    "evaluadores_matrix": professor_section("evaluadores", ancho=8),
    "directores_matrix_total": professor_section("directores_total", ancho=8),
    "evaluadores_matrix_total": professor_section("evaluadores_total", ancho=8),
    "profesores_zip": professor_section("lado_a_lado", ancho=8),
    "periodos_bloques": professor_section("periodos", ancho=8),
    "directores_celdas": professor_section("directores"),
    "evaluadores_celdas": professor_section("evaluadores"),
    "directores_celdas_total": professor_section("directores_total"),
    "evaluadores_celdas_total": professor_section("evaluadores_total"),
    "lado_a_lado_celdas": professor_section("lado_a_lado"),
    "modalidad_dynamics": modality.modality_report,
    "modalidad_rollup": lambda t: modality.hierarchy(modality.dynamics(t)),
    "modalidad_nested": modality_nested,
    "column_widths": widths,
    "sink_roundtrip": sink_roundtrip,
    "labelled_moments": labelled_moments,
}
