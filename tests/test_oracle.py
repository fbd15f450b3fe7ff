"""Every query against its SQL, and relations between the results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eavista.operators.matrix import ALL, CELL, COLUMN, ROW
from eavista.plans import modality, professors, statistics
from eavista.plans.general import general_report
from tests.conftest import SF_DIR
from verification import oracle
from verification.catalog import QUERIES
from verification.compare import connect, differences


@pytest.fixture(scope="module")
def sql():
    return entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql(sql):
    assert set(oracle.oracle_sql()) == set(QUERIES)
    assert set(QUERIES) <= set(sql) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(tables, connection, sql, name):
    assert differences(QUERIES[name](tables), connection, sql[name]) == []


def test_entry_is_the_general_report(spark):
    frame = entry.entry(spark)
    assert len(frame.columns) == 33
    assert frame.count() == 975


def test_one_row_per_live_formal_project(tables):
    formal = tables.solicitudes.filter("tipo_solicitud_id = 2 AND deleted_at IS NULL")
    report = general_report(tables)
    assert report.count() == formal.count() == report.select("id").distinct().count()


def test_semester_counts_add_up(tables):
    projects = statistics.formal_projects(tables).filter("valores_fase > 0").count()
    cells = statistics.committee_cells(tables)
    assert statistics.by_semester(cells).agg(F.sum("proyectos_recibidos")).first()[0] == projects
    assert modality.dynamics(tables).agg(F.sum("cantidad")).first()[0] == projects


def test_matrix_totals_agree(tables):
    matrix, periods = professors.every_cell(tables)
    for section in professors.SECTIONS:
        mine = [r for r in matrix.collect() if r.rol == section]
        (whole,) = [r.n for r in mine if r.nivel == ALL]
        for level in (CELL, ROW, COLUMN):
            assert whole == sum(r.n or 0 for r in mine if r.nivel == level)
        assert len([r for r in mine if r.nivel == COLUMN]) == periods.count()


def test_subtotals_are_the_sum_of_their_rows(tables):
    rows = modality.with_subtotals(modality.dynamics(tables)).collect()
    details = [r for r in rows if r.grupo == modality.DETAIL]
    for top in (r for r in rows if r.grupo == modality.PERIOD):
        assert top.cantidad == sum(r.cantidad for r in details if r.periodo == top.periodo)
    whole = [r for r in rows if r.grupo == modality.ALL]
    assert [r.cantidad for r in whole] == [sum(r.cantidad for r in details)]
