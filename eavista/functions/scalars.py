"""Text-to-id casts, date arithmetic and composite report text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unsigned_cast(text: Column) -> Column:
    """``CAST(text AS UNSIGNED)``: leading digits as a bigint, other text 0, NULL stays NULL.

    A plain cast fails the job on text such as ``'12abc'`` in ANSI mode. Signs
    and numbers beyond 64 bits give 0, which is never an id.
    """
    digits = F.nullif(F.regexp_extract(text, r"^[ \t]*[+]?([0-9]+)", 1), F.lit(""))
    return F.when(text.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint")))


def canonical_id(text: Column) -> Column:
    """The bigint whose decimal form is exactly ``text``, else NULL."""
    return F.when(text.rlike(r"^(0|[1-9][0-9]*)$"), text.try_cast("bigint"))


def days_after(moment: Column, days: int) -> Column:
    """``DATE_ADD``: a date stays a date and a timestamp keeps its time of day."""
    return moment + F.expr(f"INTERVAL '{int(days)}' DAY")


def zero_if_null(number: Column) -> Column:
    return F.coalesce(number, F.lit(0))


def blank_if_zero(number: Column) -> Column:
    return F.nullif(number, F.lit(0))


def preferred_text(text: Column, fallback: Column) -> Column:
    """``text`` unless it is NULL or empty, then ``fallback``."""
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def active_text(total: Column, technology: Column, engineering: Column) -> Column:
    return F.format_string(
        "%d (%d Tecnología y %d Ingeniería)",
        zero_if_null(total), zero_if_null(technology), zero_if_null(engineering),
    )


def received_text(projects: Column, students: Column) -> Column:
    return F.format_string("%d (%d estudiantes)", zero_if_null(projects), zero_if_null(students))


def matching_text(projects: Column, students: Column) -> Column:
    return F.format_string(
        "%d (Corresponde a %d estudiantes)", zero_if_null(projects), zero_if_null(students)
    )
