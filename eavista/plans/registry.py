"""Reports by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from eavista.operators.layout import labelled
from eavista.plans import beneficiaries, general, insurance, modality, professors, statistics
from eavista.sources.shared import materialized
from eavista.sources.sink import write_report
from eavista.sources.tables import Tables


@dataclass(frozen=True)
class Report:
    title: str
    build: Callable[..., dict[str, DataFrame]]
    filters: tuple[str, ...] = ()
    section_titles: Mapping[str, str] = field(default_factory=dict)


def _general(tables: Tables, **filters) -> dict[str, DataFrame]:
    return {"reporte": labelled(general.general_report(tables, **filters), general.EXPORT)}


def _insurance(tables: Tables) -> dict[str, DataFrame]:
    return {"reporte": labelled(insurance.insurance_report(tables), insurance.EXPORT)}


def _beneficiaries(tables: Tables) -> dict[str, DataFrame]:
    return {"reporte": labelled(beneficiaries.beneficiary_report(tables), beneficiaries.EXPORT)}


def _statistics(tables: Tables) -> dict[str, DataFrame]:
    cells = materialized(statistics.committee_cells(tables))
    shown = {
        "por_semestre": statistics.semester_text(cells),
        "aprobacion": statistics.approval_text(cells),
        "por_modalidad": statistics.modality_rows(cells),
    }
    return {
        section: labelled(frame, statistics.SECTION_LABELS[section])
        for section, frame in shown.items()
    }


def _modality(tables: Tables) -> dict[str, DataFrame]:
    rows = materialized(modality.dynamics(tables))
    return {"reporte": labelled(modality.hierarchy(rows), modality.LABELS)}


# The report names.
REPORTS: dict[str, Report] = {
    "general_report": Report(
        general.TITLE, _general, ("estado", "fecha_inicio", "fecha_fin")
    ),
    "arl_report": Report(insurance.TITLE, _insurance),
    "beneficiarios_tyt_report": Report(beneficiaries.TITLE, _beneficiaries),
    "estadisticas_report": Report(
        statistics.TITLE, _statistics, section_titles=statistics.SECTION_TITLES
    ),
    "dinamica_profesores_report": Report(
        professors.TITLE, professors.professor_report, ("periodos", "ancho"), section_titles=professors.SECTION_TITLES
    ),
    "dinamica_modalidad_report": Report(modality.TITLE, _modality),
}


def run_report(
    spark: SparkSession, name: str, tables: Tables, **filters: str | int | Sequence[str] | None
) -> dict[str, DataFrame]:
    """The sections of a report as DataFrames; unknown names raise ``KeyError``.

    Each report takes the filters it declares; others are ignored.
    """
    report = REPORTS[name]
    return report.build(tables, **{f: filters[f] for f in report.filters if f in filters})


def export_report(
    spark: SparkSession,
    name: str,
    tables: Tables,
    base: str,
    run_id: str,
    file_format: str = "parquet",
    **filters: str | int | Sequence[str] | None,
) -> dict[str, str]:
    """Run a report and write its sections under ``base``; returns the paths."""
    sections = run_report(spark, name, tables, **filters)
    report = REPORTS[name]
    return write_report(
        sections, base, name, run_id, report.title, file_format, report.section_titles
    )
