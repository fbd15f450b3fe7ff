"""Report columns: labels, text form and width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> Column:
    """The column of that exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def labelled(frame: DataFrame, columns: Sequence[tuple[str, ...]]) -> DataFrame:
    """The listed (label, key) or (label, key, group) columns in order, labels as column metadata.

    A key the frame lacks becomes NULL text; moments with a time become text;
    columns not listed drop. Labels may repeat, keys name the columns. A group is the
    header above several columns.
    """
    return frame.select(*[
        _cell(frame, key).alias(key, metadata={"label": label, **({"group": group[0]} if group else {})})
        for label, key, *group in columns
    ])


def _cell(frame: DataFrame, key: str) -> Column:
    if key not in frame.columns:
        return F.lit(None).cast("string")
    if isinstance(frame.schema[key].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(quoted(key), "yyyy-MM-dd HH:mm:ss")
    return quoted(key)


def column_widths(frame: DataFrame, cap: int = 40) -> DataFrame:
    """(columna, ancho): longest cell or label plus 2, at most ``cap``.

    Blank cells (NULL, zero, empty, false) do not count. One pass, one row of
    maxima, then turned into rows.
    """
    widths = []
    for field in frame.schema:
        label = (field.metadata or {}).get("label", field.name)
        longest = F.max(F.when(_filled(field), F.length(quoted(field.name).cast("string"))))
        width = F.greatest(F.coalesce(longest, F.lit(0)), F.lit(len(label))) + 2
        widths.append(F.least(width, F.lit(cap)).alias(field.name))
    return frame.agg(*widths).unpivot(
        [], [quoted(c) for c in frame.columns], "columna", "ancho"
    )


def _filled(field: T.StructField) -> Column:
    cell = quoted(field.name)
    if isinstance(field.dataType, T.NumericType):
        return cell != 0
    if isinstance(field.dataType, T.StringType):
        return cell != ""
    if isinstance(field.dataType, T.BooleanType):
        return cell
    return cell.isNotNull()
