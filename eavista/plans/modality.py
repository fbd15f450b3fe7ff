"""Modality dynamics: projects and approvals per period and modality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eavista.functions.scalars import blank_if_zero
from eavista.operators.totals import nested_rows, total_row
from eavista.plans.statistics import APPROVED, formal_projects
from eavista.sources.tables import Tables

# Title, labels in order, and the text of the total.
TITLE = "Dinámica por Modalidad - Trabajos de Grado"
LABELS = [
    ("MODALIDADES", "etiqueta"),
    ("Cantidad por Modalidad", "cantidad"),
    ("APROBADOS POR MODALIDAD", "aprobados_visible"),
]
TOTAL_LABEL = "Total general"
DETAIL, PERIOD, ALL = 0, 1, 3


def dynamics(tables: Tables) -> DataFrame:
    """Live formal projects that have any value of their phase, by period and modality."""
    projects = formal_projects(tables, modalities=True).filter(F.col("valores_fase") > 0)
    approved = F.when(F.col("estado").isin(APPROVED), 1).otherwise(0)
    return projects.groupBy("periodo", "modalidad").agg(
        F.count(F.lit(1)).alias("cantidad"), F.sum(approved).alias("aprobados")
    )


def modality_report(tables: Tables) -> DataFrame:
    return dynamics(tables).orderBy("periodo", F.col("cantidad").desc(), "modalidad")


def with_subtotals(rows: DataFrame) -> DataFrame:
    """A row per period, its modalities below, a grand total; made from the counted rows.

    ``grupo`` tells a subtotal (1) or the total (3) from a detail row (0) whose
    modality is NULL. A zero count of approvals shows as blank but in the total,
    which is there, as zeros, even without projects.
    """
    amounts = ["cantidad", "aprobados"]
    levels = rows.groupingSets([["periodo", "modalidad"], ["periodo"]], "periodo", "modalidad").agg(
        F.grouping_id().cast("int").alias("grupo"), *[F.sum(a).alias(a) for a in amounts]
    )
    period = F.when(F.col("grupo") == PERIOD, F.col("periodo"))
    labelled = levels.select(
        "grupo",
        "periodo",
        "modalidad",
        F.when(F.col("grupo") == DETAIL, F.col("modalidad")).otherwise(period).alias("etiqueta"),
        *amounts,
        blank_if_zero(F.col("aprobados")).alias("aprobados_visible"),
    )
    total = total_row(
        rows.select("modalidad", *amounts), "modalidad", TOTAL_LABEL, amounts
    ).select(
        F.lit(ALL).alias("grupo"),
        F.lit(None).cast("string").alias("periodo"),
        F.lit(None).cast("string").alias("modalidad"),
        F.col("modalidad").alias("etiqueta"),
        *amounts,
        F.col("aprobados").alias("aprobados_visible"),
    )
    return labelled.unionByName(total)


def hierarchy(rows: DataFrame) -> DataFrame:
    """The subtotal rows in reading order: total last, each period before its modalities."""
    return with_subtotals(rows).orderBy(
        F.col("grupo") == ALL,
        "periodo",
        F.col("grupo").desc(),
        F.col("cantidad").desc(),
        "modalidad",
    )


def nested(rows: DataFrame) -> DataFrame:
    """One row per period with its modalities, the largest first; at most one per modality."""
    return nested_rows(rows, "periodo", sort_by="cantidad", tie="modalidad")
