"""The eight input tables: their contract, and readers for files, catalog and JDBC."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The columns each report reads. A moment column (None) may be a
# date, a timestamp or a timestamp without zone; its type is left as stored.
COLUMNS: dict[str, dict[str, T.DataType | None]] = {
    "solicitudes": {
        "id": T.LongType(),
        "tipo_solicitud_id": T.IntegerType(),
        "estado": T.StringType(),
        "created_at": None,
        "deleted_at": None,
    },
    "valores_campos": {
        "solicitud_id": T.LongType(),
        "campo_id": T.IntegerType(),
        "valor": T.StringType(),
    },
    "campos": {
        "id": T.IntegerType(),
        "tipo_solicitud_id": T.IntegerType(),
        "name": T.StringType(),
    },
    "users": {
        "id": T.LongType(),
        "name": T.StringType(),
        "nro_documento": T.StringType(),
        "nro_celular": T.StringType(),
        "email": T.StringType(),
    },
    "niveles": {"id": T.IntegerType(), "nombre": T.StringType()},
    "modalidades": {"id": T.IntegerType(), "nombre": T.StringType()},
    "tipos_solicitudes": {"id": T.IntegerType(), "nombre": T.StringType()},
    "actas": {
        "id": T.LongType(),
        "proyecto_id": T.LongType(),
        "descripcion": T.StringType(),
        "numero": T.StringType(),
        "fecha": None,
        "deleted_at": None,
    },
}

# The column a relational source is read in ranges of; the catalogs need none.
RANGE_COLUMN = {
    "solicitudes": "id",
    "valores_campos": "solicitud_id",
    "users": "id",
    "actas": "proyecto_id",
}


@dataclass(frozen=True)
class Tables:
    solicitudes: DataFrame
    valores_campos: DataFrame
    campos: DataFrame
    users: DataFrame
    niveles: DataFrame
    modalidades: DataFrame
    tipos_solicitudes: DataFrame
    actas: DataFrame

    @classmethod
    def load(cls, read: Callable[[str], DataFrame]) -> Tables:
        return cls(**{name: conform(name, read(name)) for name in table_names()})


def table_names() -> list[str]:
    return [field.name for field in fields(Tables)]


def conform(name: str, frame: DataFrame) -> DataFrame:
    """Keep the contract's columns with the contract's types; fail on a missing column."""
    contract = COLUMNS[name]
    missing = [column for column in contract if column not in frame.columns]
    if missing:
        raise ValueError(f"table {name} lacks columns {missing}")
    return frame.select(
        *[
            F.col(column) if kind is None or frame.schema[column].dataType == kind
            else F.col(column).cast(kind).alias(column)
            for column, kind in contract.items()
        ]
    )


def read_files(spark: SparkSession, path: str, file_format: str = "parquet") -> Tables:
    """Tables stored as ``path/<table>`` in a format that carries its own schema."""
    return Tables.load(lambda name: spark.read.format(file_format).load(f"{path}/{name}"))


def read_catalog(spark: SparkSession, database: str) -> Tables:
    return Tables.load(lambda name: spark.table(f"{database}.{name}"))


# Ranges that one grouped count tells apart.
COARSE = 4096

# (first key, keys in a range, end) -> rows of (number of the range, rows in it).
CountRanges = Callable[[int, int, int], list[tuple[int, int]]]


def read_jdbc(
    spark: SparkSession,
    url: str,
    partitions: int = 64,
    fetch_size: int = 10_000,
    **connection: str,
) -> Tables:
    """Tables of a relational database, the large ones read in ranges of their key.

    The ranges hold about as many rows each, whatever gaps and clusters the keys have:
    the database counts them first. Rows that come in meanwhile are in one range too.
    """

    def ask(query: str) -> list:
        frame = spark.read.format("jdbc").options(url=url, query=query, **connection).load()
        return [tuple(row) for row in frame.collect()]

    def read(name: str) -> DataFrame:
        properties = {"fetchsize": str(fetch_size), **connection}
        key = RANGE_COLUMN.get(name)
        if key is None or partitions <= 1:
            return spark.read.jdbc(url, name, properties=properties)
        (lowest, highest), = ask(bounds_query(name, key))
        if lowest is None:
            return spark.read.jdbc(url, name, properties=properties)
        cuts = balanced_cuts(
            lambda lo, width, hi: ask(count_query(name, key, lo, width, hi)), int(lowest), int(highest), partitions
        )
        return spark.read.jdbc(url, name, predicates=range_predicates(key, cuts), properties=properties)

    return Tables.load(read)


def bounds_query(table: str, key: str) -> str:
    return f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}"


def count_query(table: str, key: str, lo: int, width: int, hi: int) -> str:
    """Rows per range of ``width`` keys from ``lo`` to below ``hi``; at most ``COARSE`` rows come back."""
    number = f"FLOOR(({key} - ({lo})) / {width})"
    return f"SELECT {number} AS tramo, COUNT(*) AS n FROM {table} WHERE {key} >= {lo} AND {key} < {hi} GROUP BY {number}"


def balanced_cuts(count: CountRanges, lowest: int, highest: int, partitions: int) -> list[int]:
    """Keys at which to cut, so that ranges between them hold about as many rows.

    Coarse ranges are counted; one that holds more than a fair share is counted again in
    finer ones, down to single keys, which cannot be cut.
    """
    rows = _counted(count, lowest, highest + 1)
    fair = sum(n for _, _, n in rows) / partitions
    while True:
        wide = [r for r in rows if r[2] > fair / 2 and r[1] - r[0] > 1]
        if not wide:
            break
        finer = [part for start, end, _ in wide for part in _counted(count, start, end)]
        rows = sorted([r for r in rows if r not in set(wide)] + finer)
    cuts, held = [], 0
    for start, _, n in rows:
        # A range ends before what would take it further from its share than it is.
        if held and held + n / 2 > fair:
            cuts.append(start)
            held = 0
        held += n
    return cuts


def _counted(count: CountRanges, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, rows) of the ranges between that hold any."""
    width = -(-(end - start) // COARSE)
    found = sorted((int(number), int(n)) for number, n in count(start, width, end))
    return [(start + i * width, min(start + (i + 1) * width, end), n) for i, n in found]


def range_predicates(key: str, cuts: list[int]) -> list[str]:
    """Conditions of which every row, also one whose key is NULL, meets exactly one."""
    if not cuts:
        return ["1 = 1"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *inner, f"{key} >= {cuts[-1]}"]


def write_files(tables: Tables, path: str) -> None:
    """Store the tables as parquet in the layout the reports prune best.

    Values are partitioned by attribute, so a report reads only the attributes it
    names; projects by type. Rebalancing splits an attribute or type that holds
    much of the data over many files and keeps small ones in one.
    """
    layout = {"valores_campos": ["campo_id"], "solicitudes": ["tipo_solicitud_id"]}
    for name in table_names():
        frame = getattr(tables, name)
        columns = layout.get(name, [])
        if name in RANGE_COLUMN:
            frame = frame.hint("rebalance", *columns)
        frame.write.partitionBy(*columns).parquet(f"{path}/{name}")
