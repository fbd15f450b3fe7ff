"""Person-by-period matrices with totals, and two of them side by side.

The long form has a row per cell and per total, all of one pass. The block form is wide for
any number of periods: a row per person and block of periods, in columns by position. The
wide form has a column per period of a list that the caller passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from eavista.operators.ranking import with_position
from eavista.operators.skew import spread_join

TOTAL = "total_general"
TOTAL_LABEL = "Total general"
# Levels of the long form, as the grouping sets number them: the person or the period left out.
CELL, ROW, COLUMN, ALL = 0, 1, 2, 3
# Periods in a row of the block form.
WIDTH = 50


def shown_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, periodo, n): of several groups that show one period the greatest counts."""
    last = F.max(F.struct("periodo_grupo", "total_periodo")).getField("total_periodo")
    return cells.groupBy(*keys, "periodo").agg(last.alias("n"))


def long_matrix(
    cells: DataFrame, group: str, name: str, sections: Sequence[str], periods: DataFrame
) -> DataFrame:
    """(group, nivel, name, periodo, n): every cell of a listed period, and the totals of rows, columns and all.

    ``periods`` has each listed period once. A person without a listed period has the
    total 0; a period without cells, or a section without people, has a blank one.
    """
    listed = spread_join(shown_cells(cells, [group, name]), periods.select("periodo"), "periodo", spread_on=name)
    kinds = {group: "string", name: "string", "periodo": "string", "n": "bigint", "persona": "int", "celda": "int"}

    def part(frame: DataFrame, **given: Column | int | str) -> DataFrame:
        values = {c: given.get(c, F.lit(None)) for c in kinds}
        return frame.select(*[
            (F.lit(v) if isinstance(v, int) else F.col(v) if isinstance(v, str) else v).cast(kinds[c]).alias(c)
            for c, v in values.items()
        ])

    every = F.explode(F.array(*[F.lit(s) for s in sections]))
    none = periods.select("periodo", every.alias(group))
    empty = periods.sparkSession.range(1).select(every.alias(group))
    rows = part(listed, **{group: group, name: name}, periodo="periodo", n="n", persona=1, celda=1)
    rows = rows.unionByName(part(cells, **{group: group, name: name}, n=0, persona=1, celda=0))
    rows = rows.unionByName(part(none, **{group: group}, periodo="periodo", persona=0, celda=0))
    rows = rows.unionByName(part(empty, **{group: group}, persona=0, celda=0))
    sets = [[group, name, "periodo"], [group, name], [group, "periodo"], [group]]
    sums = rows.groupingSets(sets, group, name, "periodo").agg(
        F.grouping_id().cast("int").alias("nivel"),
        F.sum("n").alias("n"), F.max("persona").alias("persona"), F.max("celda").alias("celda"),
    )
    level = F.col("nivel")
    there = (
        F.when(level == CELL, F.col("celda") == 1)
        .when(level == ROW, F.col("persona") == 1)
        .when(level == COLUMN, F.col("periodo").isNotNull())
        .otherwise(True)
    )
    shown = F.when(level >= COLUMN, F.nullif("n", F.lit(0))).otherwise(F.col("n"))
    return sums.filter(there).select(group, "nivel", name, "periodo", shown.alias("n"))


def rows_of(matrix: DataFrame, name: str) -> DataFrame:
    """(others, name, es_total, periodo, n): the cells and row totals."""
    return _shown(matrix.filter(F.col("nivel") <= ROW), F.col(name), name)


def totals_of(matrix: DataFrame, name: str) -> DataFrame:
    """The same of the totals row."""
    return _shown(matrix.filter(F.col("nivel") >= COLUMN), F.lit(TOTAL_LABEL), name)


def _shown(matrix: DataFrame, label: Column, name: str) -> DataFrame:
    rest = [c for c in matrix.columns if c not in ("nivel", name, "periodo", "n")]
    last = F.col("nivel") % 2
    period = F.when(last == 1, TOTAL_LABEL).otherwise(F.col("periodo"))
    return matrix.select(*rest, label.alias(name), last.alias("es_total"), period.alias("periodo"), "n")


def ranked_people(matrix: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name, fila): the place of each person in their section, by name."""
    return with_position(matrix.filter(F.col("nivel") == ROW).select(group, name), group, name)


def long_side_by_side(matrix: DataFrame, group: str, name: str, sections: Sequence[str]) -> DataFrame:
    """(fila, es_total, periodo) with the cell of the i-th row of each section.

    A section's columns are its name and ``<section>_n``; both are NULL where it has no
    such cell. The total row has the names of all sections that reach so far down.
    """
    rows = _with_rows(rows_of(matrix, name), ranked_people(matrix, group, name), group, name)
    columns = []
    for section in sections:
        here = F.col(group) == section
        columns.append(F.max(F.when(here, F.col(name))).alias(section))
        columns.append(F.max(F.when(here, F.col("n"))).alias(f"{section}_n"))
    return rows.groupBy("fila", "es_total", "periodo").agg(*columns)


def _with_rows(rows: DataFrame, people: DataFrame, group: str, name: str) -> DataFrame:
    mine = (F.col("m." + group) == F.col("p." + group)) & F.col("m." + name).eqNullSafe(F.col("p." + name))
    return rows.alias("m").join(people.alias("p"), mine).select("fila", "m.*")


def placed_periods(periods: DataFrame, width: int = WIDTH) -> DataFrame:
    """(periodo, bloque, lugar): the block of each period, in order, and its place there, both from 1."""
    placed = with_position(periods.select("periodo", F.lit(0).alias("grupo")), "grupo", "periodo")
    before = F.col("fila") - 1
    return placed.select(
        "periodo", (F.floor(before / width) + 1).cast("int").alias("bloque"), (before % width + 1).cast("int").alias("lugar")
    )


def place_columns(count: int) -> list[str]:
    """Columns by position, so that no period's name can meet another column's."""
    return [f"p_{i:0{max(3, len(str(count)))}d}" for i in range(1, count + 1)]


def _placed(matrix: DataFrame, periods: DataFrame) -> DataFrame:
    """Cells and column totals at their block and place; other totals at place 0 of the first block."""
    by_period = matrix.filter(F.col("nivel").isin(CELL, COLUMN))
    cells = spread_join(by_period, periods, "periodo", spread_on="n", kept=True)
    rest = matrix.filter(F.col("nivel").isin(ROW, ALL)).withColumns({"bloque": F.lit(1), "lugar": F.lit(0)})
    return cells.unionByName(rest).drop("periodo")


def _spread(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    at = [F.max(F.when(F.col("lugar") == i, F.col("n"))).alias(c) for i, c in enumerate(place_columns(width), 1)]
    return rows.groupBy(*keys, "bloque").agg(*at, F.max(F.when(F.col("lugar") == 0, F.col("n"))).alias(TOTAL))


def block_matrix(matrix: DataFrame, name: str, periods: DataFrame, width: int = WIDTH) -> DataFrame:
    """(name, bloque, p_001..., total_general): a row per person and block of ``width`` periods.

    The first block has a row of every person, with the row total; others have rows of
    people with cells there. ``periods`` (see ``placed_periods``) tells what stands where.
    """
    return _spread(_placed(matrix.filter(F.col("nivel") <= ROW), periods), [name], width)


def block_total(matrix: DataFrame, name: str, periods: DataFrame, width: int = WIDTH) -> DataFrame:
    """The totals row, a row per block."""
    rows = _spread(_placed(matrix.filter(F.col("nivel") >= COLUMN), periods), [], width)
    return rows.select(F.lit(TOTAL_LABEL).alias(name), *rows.columns)


def block_side_by_side(
    matrix: DataFrame, group: str, name: str, sections: Sequence[str], periods: DataFrame, width: int = WIDTH
) -> DataFrame:
    """(fila, bloque) with the i-th row of each section: its name, ``<section>_p_001``... and total.

    A section without cells in a block has NULLs there, and its name in the first block only.
    """
    placed = _placed(matrix.filter(F.col("nivel") <= ROW), periods)
    rows = _with_rows(placed, ranked_people(matrix, group, name), group, name)
    columns = []
    for section in sections:
        here = F.col(group) == section
        columns.append(F.max(F.when(here, F.col(name))).alias(section))
        for i, column in [*enumerate(place_columns(width), 1), (0, TOTAL)]:
            columns.append(F.max(F.when(here & (F.col("lugar") == i), F.col("n"))).alias(f"{section}_{column}"))
    return rows.groupBy("fila", "bloque").agg(*columns)


def period_matrix(cells: DataFrame, keys: Sequence[str], periods: Sequence[str]) -> DataFrame:
    """One row per key, a column by position per listed period, and the row total.

    Of several groups that show the same period, the one with the greatest group
    period counts (NULL lowest). Periods not listed do not appear or count.
    """
    matrix = shown_cells(cells, keys).groupBy(*keys).pivot("periodo", list(periods)).agg(F.first("n"))
    columns = place_columns(len(periods))
    matrix = matrix.toDF(*keys, *columns)
    # An array and not a chain of sums, which a long list would nest too deep.
    counts = F.array(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in columns]).cast("array<bigint>")
    return matrix.withColumn(TOTAL, F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b))


def matrix_total(matrix: DataFrame, name: str, periods: Sequence[str]) -> DataFrame:
    """The totals row; a total of zero is blank."""
    columns = [*place_columns(len(periods)), TOTAL]
    sums = [F.nullif(F.sum(c), F.lit(0)).alias(c) for c in columns]
    return matrix.agg(*sums).select(F.lit(TOTAL_LABEL).alias(name), *columns)


def side_by_side(
    matrix: DataFrame, group: str, name: str, sections: Sequence[str], periods: Sequence[str]
) -> DataFrame:
    """The i-th row of each section in one row; a shorter section ends in NULLs."""
    placed = with_position(matrix, group, name)
    out = None
    for section in sections:
        part = placed.filter(F.col(group) == section).select(
            "fila",
            F.col(name).alias(section),
            *[F.col(c).alias(f"{section}_{c}") for c in [*place_columns(len(periods)), TOTAL]],
        )
        out = part if out is None else out.join(part, "fila", "full_outer")
    return out
