"""First live milestone of each kind per project, and the dates that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eavista.functions.scalars import days_after
from eavista.operators.filters import live

# The kinds as stored, and the spans in days.
KINDS = {
    "aprobacion": "Aprobación de la propuesta",
    "final": "Aprobación del informe final",
    "prorroga": "Aplazamiento de la propuesta",
}
MINIMUM_DAYS = 90
DUE_DAYS = 180
EXTENSION_DAYS = 180


def first_milestones(actas: DataFrame) -> DataFrame:
    """(project, ``<kind>`` struct of id, numero, fecha) of the smallest id per kind."""
    dated = live(actas).filter(F.col("descripcion").isin(list(KINDS.values())))
    entry = F.struct("id", "numero", "fecha")
    return (
        dated.groupBy(F.col("proyecto_id").alias("solicitud_id"))
        .agg(*[
            F.min(F.when(F.col("descripcion") == text, entry)).alias(kind)
            for kind, text in KINDS.items()
        ])
    )


def with_deadlines(frame: DataFrame) -> DataFrame:
    """Adds the earliest and the due date; an extension only counts by being dated."""
    approved = F.col("aprobacion.fecha")
    extended = F.col("prorroga.fecha").isNotNull()
    return frame.withColumns({
        "fecha_minima": days_after(approved, MINIMUM_DAYS),
        "fecha_maxima": F.when(extended, days_after(approved, DUE_DAYS + EXTENSION_DAYS))
        .otherwise(days_after(approved, DUE_DAYS)),
    })
