"""Professor workload: values and projects per person and period, for two roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from eavista.operators.attributes import attribute_rows, first, greatest
from eavista.operators.filters import projects_of
from eavista.operators.layout import labelled
from eavista.operators.matrix import (
    TOTAL,
    TOTAL_LABEL,
    WIDTH,
    block_matrix,
    block_side_by_side,
    block_total,
    long_matrix,
    long_side_by_side,
    matrix_total,
    period_matrix,
    place_columns,
    placed_periods,
    rows_of,
    side_by_side,
    totals_of,
)
from eavista.operators.references import project_frame
from eavista.plans.general import FORMAL
from eavista.sources.shared import materialized, written
from eavista.sources.tables import Tables

SECTIONS = ("director", "evaluador")
PERIOD = first("periodo", FORMAL)

# Titles.
TITLE = "Dinámica de Profesores - Trabajos de Grado"
SECTION_TITLES = {
    "directores": "ASIGNACIÓN DE DIRECCIÓN DE TRABAJO DE GRADO",
    "evaluadores": "ASIGNACIÓN DE EVALUADOR DE TRABAJO DE GRADO",
}
GROUP = "APROBACIÓN PROPUESTA F-DC-125 - F-DC-128"


def period_list(tables: Tables) -> DataFrame:
    """Every phase period stored, whatever its project's type or state."""
    rows = attribute_rows(tables.valores_campos, tables.campos, PERIOD)
    return (
        rows.filter(F.col("valor").isNotNull())
        .select(F.col("valor").alias("periodo"))
        .distinct()
        .orderBy("periodo")
    )


def workload(
    tables: Tables, sections: Sequence[str] = SECTIONS, broadcast_people: bool | None = None
) -> DataFrame:
    """(rol, nombre, periodo_grupo) with the shown period and the counts.

    ``total_periodo`` counts the attribute values of the person's projects, as
    the report does; ``n_proyectos`` counts the projects. The group is the
    period of the formal phase, the shown one the greatest of any phase.
    """
    projects = project_frame(
        tables,
        projects_of(tables.solicitudes, FORMAL).select("id"),
        attributes={"periodo": greatest("periodo"), "periodo_grupo": PERIOD},
        people={section: ("name",) for section in sections},
        counts={"n_valores": None},
        broadcast_people=broadcast_people,
    )
    people = F.array(*[
        F.struct(
            F.lit(section).alias("rol"),
            F.col(f"{section}_ok").alias("usuario_id"),
            F.col(f"{section}_name").alias("nombre"),
        )
        for section in sections
    ])
    return (
        projects.select("periodo", "periodo_grupo", "n_valores", F.explode(people).alias("p"))
        .filter(F.col("p.usuario_id").isNotNull())
        .groupBy("p.rol", "p.nombre", "periodo_grupo")
        .agg(
            F.max("periodo").alias("periodo"),
            F.sum("n_valores").alias("total_periodo"),
            F.count(F.lit(1)).alias("n_proyectos"),
        )
    )


def long_section(cells: DataFrame, section: str) -> DataFrame:
    return (
        cells.filter(F.col("rol") == section)
        .orderBy("nombre", "periodo", "periodo_grupo")
        .select("nombre", "periodo", "periodo_grupo", "total_periodo", "n_proyectos")
    )


def section_matrix(cells: DataFrame, section: str, periods: Sequence[str]) -> DataFrame:
    return period_matrix(cells.filter(F.col("rol") == section), ["nombre"], periods)


def section_total(cells: DataFrame, section: str, periods: Sequence[str]) -> DataFrame:
    return matrix_total(section_matrix(cells, section, periods), "nombre", periods)


def zipped(cells: DataFrame, periods: Sequence[str]) -> DataFrame:
    """The i-th director beside the i-th evaluator, by name."""
    matrix = materialized(period_matrix(cells, ["rol", "nombre"], periods))
    return side_by_side(matrix, "rol", "nombre", SECTIONS, periods).orderBy("fila")


def every_cell(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The long matrix of both roles with all totals, and the listed periods; both computed once."""
    periods = written(period_list(tables))
    cells = written(workload(tables))
    return written(long_matrix(cells, "rol", "nombre", SECTIONS, periods)), periods


def long_columns(section: str) -> list[tuple[str, str, str]]:
    shown = [(section.upper(), "nombre"), ("Es total", "es_total"), ("Periodo", "periodo"), ("Total", "n")]
    return [(*column, GROUP) for column in shown]


def block_columns(section: str, width: int) -> list[tuple[str, str, str]]:
    """Labels of the block form; which period a place has is told by the section of the periods."""
    places = [(f"Lugar {i}", c) for i, c in enumerate(place_columns(width), 1)]
    shown = [(section.upper(), "nombre"), ("Bloque", "bloque"), *places, (TOTAL_LABEL, TOTAL)]
    return [(*column, GROUP) for column in shown]


def professor_report(
    tables: Tables, periodos: Sequence[str] | None = None, ancho: int | None = None
) -> dict[str, DataFrame]:
    """Matrices in long form; in blocks of ``ancho`` periods; or with a column per listed period of ``periodos``."""
    if periodos is not None:
        return wide_report(tables, periodos)
    matrix, periods = every_cell(tables)
    if ancho is not None:
        return block_report(matrix, periods, ancho)
    out = {"periodos": periods.orderBy("periodo")}
    for section, name in zip(SECTIONS, ("directores", "evaluadores")):
        mine = matrix.filter(F.col("rol") == section).drop("rol")
        out[name] = labelled(rows_of(mine, "nombre").orderBy("nombre", "es_total", "periodo"), long_columns(section))
        out[f"{name}_total"] = labelled(
            totals_of(mine, "nombre").orderBy("es_total", "periodo"), long_columns(section)
        )
    zipped_rows = long_side_by_side(matrix, "rol", "nombre", SECTIONS)
    out["lado_a_lado"] = zipped_rows.orderBy("fila", "es_total", "periodo")
    return out


def block_report(matrix: DataFrame, periods: DataFrame, width: int = WIDTH) -> dict[str, DataFrame]:
    """The report in rows of ``width`` periods; ``periodos`` tells the block and place of each."""
    placed = written(placed_periods(periods, width))
    out = {"periodos": placed.orderBy("bloque", "lugar")}
    for section, name in zip(SECTIONS, ("directores", "evaluadores")):
        mine = matrix.filter(F.col("rol") == section).drop("rol")
        columns = block_columns(section, width)
        out[name] = labelled(block_matrix(mine, "nombre", placed, width).orderBy("nombre", "bloque"), columns)
        out[f"{name}_total"] = labelled(block_total(mine, "nombre", placed, width).orderBy("bloque"), columns)
    zipped_rows = block_side_by_side(matrix, "rol", "nombre", SECTIONS, placed, width)
    out["lado_a_lado"] = zipped_rows.orderBy("fila", "bloque")
    return out


def wide_report(tables: Tables, periods: Sequence[str]) -> dict[str, DataFrame]:
    """A column per listed period, by position; its label is the period."""
    cells = materialized(workload(tables))
    out = {"periodos": period_list(tables)}
    for section, name in zip(SECTIONS, ("directores", "evaluadores")):
        places = zip(periods, place_columns(len(periods)))
        columns = [(*c, GROUP) for c in [(section.upper(), "nombre"), *places, (TOTAL_LABEL, TOTAL)]]
        out[name] = labelled(section_matrix(cells, section, periods).orderBy("nombre"), columns)
        out[f"{name}_total"] = labelled(section_total(cells, section, periods), columns)
    out["lado_a_lado"] = zipped(cells, periods)
    return out
