"""Row filters on projects and milestones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, TimestampNTZType


def live(frame: DataFrame) -> DataFrame:
    """Rows that were not soft-deleted."""
    return frame.filter(F.col("deleted_at").isNull())


def projects_of(solicitudes: DataFrame, kind: int) -> DataFrame:
    """Live projects of one type."""
    return live(solicitudes).filter(F.col("tipo_solicitud_id") == kind)


def optional_filters(
    projects: DataFrame,
    estado: str | None = None,
    fecha_inicio: str | None = None,
    fecha_fin: str | None = None,
) -> DataFrame:
    """Only the given conditions apply; an empty text counts as not given.

    A bound without a time of day means midnight, so a bare end date leaves out
    the later rows of that day.
    """
    moment = projects.schema["created_at"].dataType
    created = F.col("created_at")
    if isinstance(moment, DateType):
        # A date is its midnight, so that a bound's time of day counts.
        moment, created = TimestampNTZType(), created.cast(TimestampNTZType())

    def bound(value: str) -> Column:
        return F.lit(value).cast(moment)

    if estado:
        projects = projects.filter(F.col("estado") == estado)
    if fecha_inicio:
        projects = projects.filter(created >= bound(fecha_inicio))
    if fecha_fin:
        projects = projects.filter(created <= bound(fecha_fin))
    return projects
