"""Write a report's sections as one run that is there whole or not at all.

``base/report=R/run_id=X/attempt=U/section=S`` holds the rows of a section, each with its
position, so that the order of a report survives files written by many tasks. A manifest
beside them lists sections, schemas, rows, files and bytes. The last thing written is the
marker ``base/report=R/run_id=X/COMPLETO``, which names the attempt and is created only where
there is none: a run that broke can be written again, one that is complete cannot, and of
two writers at once one wins. Readers go by the marker, so they never see half a run.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql import types as T

from eavista.sources.shared import written

logger = logging.getLogger(__name__)

COLUMNS_SECTION = "columnas"
MANIFEST = "manifiesto"
MARKER = "COMPLETO"
# The 1-based place of a row in its section.
POSITION = "posicion_fila"
MANIFEST_COLUMNS = (
    "seccion string, lugar int, formato string, filas long, archivos long, bytes long, esquema string"
)


class IncompleteRun(Exception):
    """No complete run of that id, or files of one that are not what its manifest says."""


def run_path(base: str, report: str, run_id: str) -> str:
    return f"{base}/report={report}/run_id={run_id}"


def section_path(base: str, report: str, run_id: str, section: str, attempt: str) -> str:
    return f"{run_path(base, report, run_id)}/attempt={attempt}/section={section}"


def write_report(
    sections: Mapping[str, DataFrame],
    base: str,
    report: str,
    run_id: str,
    title: str = "",
    file_format: str = "parquet",
    section_titles: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Write each section under ``base`` and return the paths.

    The titles, and each column's key, label, group and position, go to a section of
    their own. An empty section is written with its schema and logged.
    """
    spark = next(iter(sections.values())).sparkSession
    run = run_path(base, report, run_id)
    if _attempt_of(spark, run) is not None:
        raise FileExistsError(f"run already exists: {run}")
    attempt = uuid.uuid4().hex
    every = dict(sections)
    if COLUMNS_SECTION not in every:
        every[COLUMNS_SECTION] = _column_list(spark, sections, title, section_titles or {})
    paths, listed = {}, []
    for place, (section, frame) in enumerate(every.items()):
        path = paths[section] = section_path(base, report, run_id, section, attempt)
        seen = Observation()
        rows = _positioned(frame).observe(seen, F.count(F.lit(1)).alias("filas"))
        _writer(rows, file_format).save(path)
        count = seen.get["filas"]
        files, size = _stored_size(spark, path)
        listed.append((section, place, file_format, count, files, size, frame.schema.json()))
        if not count:
            logger.warning("report %s: section %s is empty", report, section)
    manifest = spark.createDataFrame(listed, MANIFEST_COLUMNS).coalesce(1)
    manifest.write.json(f"{run}/attempt={attempt}/{MANIFEST}")
    _mark(spark, run, attempt)
    return paths


def read_report(
    spark: SparkSession, base: str, report: str, run_id: str, position: bool = False
) -> dict[str, DataFrame]:
    """The sections of a complete run, rows in order, columns with their labels.

    Raises ``IncompleteRun`` where none is complete, or where a section's files are not as
    many and as large as the manifest says.
    """
    run = run_path(base, report, run_id)
    attempt = _attempt_of(spark, run)
    if attempt is None:
        raise IncompleteRun(f"no complete run: {run}")
    manifest = spark.read.schema(MANIFEST_COLUMNS).json(f"{run}/attempt={attempt}/{MANIFEST}")
    out = {}
    # A row per section.
    for row in sorted(manifest.collect(), key=lambda r: r.lugar):
        path = section_path(base, report, run_id, row.seccion, attempt)
        if _stored_size(spark, path) != (row.archivos, row.bytes):
            raise IncompleteRun(f"files differ from the manifest: {path}")
        schema = T.StructType.fromJson(json.loads(row.esquema))
        out[row.seccion] = read_section(spark, path, schema, row.formato, position)
    return out


def read_section(
    spark: SparkSession,
    path: str,
    like: DataFrame | T.StructType,
    file_format: str = "parquet",
    position: bool = False,
) -> DataFrame:
    """A written section in its order, with the schema of ``like``; with ``position``, each row's place."""
    schema = like if isinstance(like, T.StructType) else like.schema
    reader = spark.read.format(file_format).schema(T.StructType([*schema.fields, T.StructField(POSITION, T.LongType())]))
    if file_format == "csv":
        reader = reader.option("header", True)
    rows = reader.load(path).orderBy(POSITION)
    shown = [F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.fields]
    return rows.select(*([POSITION] if position else []), *shown)


def _positioned(frame: DataFrame) -> DataFrame:
    """``frame`` with the place of each row: the sizes of earlier partitions, and the place in its own."""
    staged = written(
        frame.withColumns({"_tramo": F.spark_partition_id(), "_orden": F.monotonically_increasing_id()})
    )
    # A row per partition that has any.
    sizes = staged.groupBy("_tramo").agg(F.count(F.lit(1)).alias("n"), F.min("_orden").alias("primero"))
    below = Window.partitionBy(F.lit(0)).orderBy("_tramo").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(below), F.lit(0)) - F.col("primero") + 1
    placed = staged.join(sizes.select("_tramo", before.alias("_antes")), "_tramo")
    return placed.withColumn(POSITION, F.col("_antes") + F.col("_orden")).drop("_tramo", "_orden", "_antes")


def _writer(frame: DataFrame, file_format: str):
    writer = frame.write.format(file_format).mode("error").option("header", True)
    return writer.option("ignoreNullFields", False)


def _files(spark: SparkSession, path: str):
    """The store's file system for ``path``, and the path in its terms."""
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _stored_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Files and bytes below ``path``; none where it is missing."""
    system, there = _files(spark, path)
    if not system.exists(there):
        return 0, 0
    summary = system.getContentSummary(there)
    return summary.getFileCount(), summary.getLength()


def _mark(spark: SparkSession, run: str, attempt: str) -> None:
    """The run is complete: created where there is no marker yet."""
    system, there = _files(spark, f"{run}/{MARKER}")
    stream = system.create(there, False)
    try:
        stream.write(bytearray(attempt.encode()))
    finally:
        stream.close()


def _attempt_of(spark: SparkSession, run: str) -> str | None:
    """The attempt that a run's marker names."""
    system, there = _files(spark, f"{run}/{MARKER}")
    if not system.exists(there):
        return None
    row = spark.read.text(f"{run}/{MARKER}").first()
    return row[0] if row else None


def _column_list(
    spark: SparkSession,
    sections: Mapping[str, DataFrame],
    title: str,
    section_titles: Mapping[str, str],
) -> DataFrame:
    rows = [
        (title, section, section_titles.get(section, ""), position, (field.metadata or {}).get("group", ""),
         field.name, (field.metadata or {}).get("label", field.name))
        for section, frame in sections.items()
        for position, field in enumerate(frame.schema)
    ]
    schema = (
        "titulo string, seccion string, titulo_seccion string, posicion int, grupo string, clave string, "
        "etiqueta string"
    )
    return spark.createDataFrame(rows, schema).coalesce(1).withColumn("escrito", F.unix_timestamp())
