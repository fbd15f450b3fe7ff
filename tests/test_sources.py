import logging
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eavista import REPORTS, run_report
from eavista.plans.registry import export_report
from eavista.sources import sink
from eavista.sources.shared import fits_broadcast, shared_folder
from eavista.sources.sink import POSITION, IncompleteRun, read_report, read_section, run_path, write_report
from eavista.sources.tables import (
    COARSE,
    balanced_cuts,
    bounds_query,
    conform,
    count_query,
    range_predicates,
    read_catalog,
    table_names,
)
from tests.tiny import DAY, project, rows_of, tiny_tables


def test_contract_casts_and_checks(spark):
    frame = spark.createDataFrame([("7", 1, 5)], "id string, nombre long, extra int")
    kept = conform("niveles", frame)
    assert kept.dtypes == [("id", "int"), ("nombre", "string")]
    assert rows_of(kept) == [(7, "1")]
    with pytest.raises(ValueError, match="nombre"):
        conform("niveles", frame.drop("nombre"))


def keyed_table(keys):
    """A table of the process's own, without a server."""
    base = duckdb.connect()
    rows = pa.table({"k": pa.array(keys, pa.int64()), "row_no": pa.array(range(len(keys)))})
    base.register("given", rows)
    base.execute("CREATE TABLE t AS SELECT * FROM given")
    return base


SKEWED = {
    "even": list(range(10_000)),
    "one far key": [*range(10_000), 10**15],
    "clusters": [*range(5000), *range(10**12, 10**12 + 5000), *[-(10**9)] * 3],
    "hot key": [*range(4000), *[77] * 6000],
    "nulls": [*range(1000), *[None] * 500],
    "one key": [5] * 100,
    "negative": list(range(-3000, -1000)),
}


@pytest.mark.parametrize("name", SKEWED)
def test_jdbc_predicates_are_even_and_meet_every_row_once(name):
    keys, partitions = SKEWED[name], 8
    base = keyed_table(keys)
    (lowest, highest), = base.sql(bounds_query("t", "k")).fetchall()
    asked = []

    def count(lo, width, hi):
        found = base.sql(count_query("t", "k", lo, width, hi)).fetchall()
        asked.append(len(found))
        return found

    predicates = range_predicates("k", balanced_cuts(count, lowest, highest, partitions))
    rows = [base.sql(f"SELECT row_no FROM t WHERE {p}").fetchall() for p in predicates]
    assert sorted(r for part in rows for (r,) in part) == list(range(len(keys)))
    assert len(predicates) <= 2 * partitions and max(asked) <= COARSE
    hottest = max(Counter(k for k in keys if k is not None).values())
    fair = len([k for k in keys if k is not None]) / partitions
    assert max(len(part) for part in rows[1:] or [[]]) <= max(1.6 * fair, hottest + fair)
    if name in ("even", "one far key", "clusters", "negative"):
        assert partitions - 1 <= len(predicates) <= partitions + 2


def test_catalog_tables(spark, tmp_path):
    t = tiny_tables(spark, solicitudes=[project(1)])
    spark.sql(f"CREATE DATABASE eav_test LOCATION '{tmp_path}/db'")
    try:
        for name in table_names():
            getattr(t, name).write.saveAsTable(f"eav_test.{name}")
        again = read_catalog(spark, "eav_test")
        assert rows_of(again.solicitudes) == [(1, 2, "Fase 1", DAY, None)]
    finally:
        spark.sql("DROP DATABASE eav_test CASCADE")


@pytest.mark.parametrize("limit, fits", [("10MB", True), ("100b", False), ("-1", False)])
def test_size_estimate_decides_broadcast(spark, settings, limit, fits):
    settings({"spark.sql.autoBroadcastJoinThreshold": limit})
    assert fits_broadcast(spark.range(100)) is fits


@pytest.mark.parametrize("file_format", ["parquet", "csv", "json", "orc"])
def test_sections_round_trip(spark, tmp_path, file_format):
    frame = spark.createDataFrame([("á", 1), (None, 2)], "clave string, n long")
    empty = frame.filter("false")
    paths = write_report(
        {"uno": frame, "dos": empty}, str(tmp_path), "r", "run-1", "Título", file_format
    )
    assert rows_of(read_section(spark, paths["uno"], frame, file_format)) == rows_of(frame)
    sections = read_report(spark, str(tmp_path), "r", "run-1")
    assert list(sections) == ["uno", "dos", "columnas"]
    assert rows_of(sections["uno"]) == rows_of(frame)
    assert sections["dos"].columns == frame.columns and sections["dos"].isEmpty()


def test_rows_come_back_in_order(spark, settings, tmp_path):
    """Over many files, some of them empty, with names that the writer uses for itself."""
    settings({"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    names = [("b", 0), ("a", 5)] * 400
    frame = spark.createDataFrame(names, "clave string, n int").withColumn("i", F.monotonically_increasing_id())
    ordered = frame.orderBy(F.col("clave").desc(), "i").select(
        F.col("clave").alias("c", metadata={"label": "Letra", "group": "G"}), "n", "i"
    )
    write_report({"uno": ordered}, str(tmp_path), "r", "x")
    sections = read_report(spark, str(tmp_path), "r", "x", position=True)
    back = sections["uno"].collect()
    assert [r[POSITION] for r in back] == list(range(1, 801))
    assert [(r.c, r.n, r.i) for r in back] == rows_of(ordered)
    assert sections["uno"].schema["c"].metadata == {"label": "Letra", "group": "G"}
    listed = sections["columnas"].collect()
    assert [(r.posicion, r.clave, r.etiqueta, r.grupo) for r in listed] == [(0, "c", "Letra", "G"), (1, "n", "n", ""), (2, "i", "i", "")]


def test_a_broken_run_is_written_again(spark, tmp_path):
    base = str(tmp_path)
    good = spark.range(5)
    broken = good.select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        write_report({"uno": good, "dos": broken}, base, "r", "x")
    with pytest.raises(IncompleteRun, match="no complete run"):
        read_report(spark, base, "r", "x")
    write_report({"uno": good, "dos": good}, base, "r", "x")
    assert [f.count() for f in read_report(spark, base, "r", "x").values()] == [5, 5, 2]
    with pytest.raises(FileExistsError):
        write_report({"uno": good}, base, "r", "x")
    assert [f.count() for f in read_report(spark, base, "r", "x").values()] == [5, 5, 2]


def test_of_two_writers_one_completes(spark, tmp_path):
    run = f"file://{tmp_path}/run"
    sink._mark(spark, run, "one")
    with pytest.raises(Exception, match="exist"):
        sink._mark(spark, run, "two")
    assert sink._attempt_of(spark, run) == "one"


def test_missing_files_are_noticed(spark, tmp_path):
    paths = write_report({"uno": spark.range(5)}, str(tmp_path), "r", "x")
    for path in Path(paths["uno"]).glob("part-*"):
        path.rename(tmp_path / path.name)
    with pytest.raises(IncompleteRun, match="differ"):
        read_report(spark, str(tmp_path), "r", "x")


def test_columns_section_and_run_ids(spark, tmp_path, caplog):
    t = tiny_tables(spark)
    with caplog.at_level(logging.WARNING):
        paths = export_report(spark, "arl_report", t, str(tmp_path), "run-1")
    assert "reporte is empty" in caplog.text
    assert paths["reporte"].startswith(run_path(str(tmp_path), "arl_report", "run-1"))
    labels = spark.read.parquet(paths["columnas"]).orderBy("posicion").collect()
    assert [(r.clave, r.etiqueta) for r in labels][:2] == [
        ("apellidos_nombres", "APELLIDOS Y NOMBRES"), ("nro_documento", "No. DE DOCUMENTO"),
    ]
    assert labels[0].titulo == REPORTS["arl_report"].title
    assert labels[0].escrito > 1_700_000_000
    with pytest.raises(FileExistsError, match="already exists"):
        export_report(spark, "arl_report", t, str(tmp_path), "run-1")


def test_unknown_report(spark, tables):
    with pytest.raises(KeyError):
        run_report(spark, "no_such_report", tables)


def test_filters_reach_only_reports_that_declare_them(spark):
    t = tiny_tables(spark, solicitudes=[project(1), project(2, estado="Fase 4")])
    general = run_report(spark, "general_report", t, estado="Fase 4", otro="x")
    assert general["reporte"].count() == 1
    modality = run_report(spark, "dinamica_modalidad_report", t, estado="Fase 4")
    assert list(modality) == ["reporte"]


def test_every_report_runs(spark, tables):
    sections = {name: run_report(spark, name, tables) for name in REPORTS}
    assert list(sections["estadisticas_report"]) == ["por_semestre", "aprobacion", "por_modalidad"]
    assert list(sections["dinamica_profesores_report"]) == [
        "periodos", "directores", "directores_total", "evaluadores", "evaluadores_total", "lado_a_lado",
    ]
    directors = sections["dinamica_profesores_report"]["directores"]
    assert directors.schema["nombre"].metadata["label"] == "DIRECTOR"
    assert all(not frame.isEmpty() for parts in sections.values() for frame in parts.values())


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert shared_folder(spark)

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
