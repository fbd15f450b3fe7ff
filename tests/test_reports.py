
import datetime as dt

import pytest
from pyspark.sql import functions as F

from eavista.operators.attributes import count_values, first, greatest, pivot_attributes, reference
from eavista.operators.layout import column_widths, labelled
from eavista.operators.members import beneficiaries
from eavista.operators.references import project_frame
from eavista.plans import modality, professors, statistics
from eavista.plans.beneficiaries import beneficiary_report
from eavista.plans.general import EXPORT, general_report
from eavista.plans.insurance import insurance_report
from eavista.plans.registry import export_report
from eavista.sources.sink import read_report
from tests.tiny import DAY, column, project, rows_of, tiny_tables, user


def general_row(spark, **rows):
    rows.setdefault("solicitudes", [project(1)])
    found = general_report(tiny_tables(spark, **rows)).collect()
    assert len(found) == 1
    return found[0]


def test_first_value_is_smallest_attribute_then_text(spark):
    t = tiny_tables(
        spark,
        campos=[(1, 2, "nivel"), (2, 2, "nivel"), (3, 3, "nivel")],
        valores_campos=[
            (1, 2, "1"), (1, 1, "9"), (1, 1, "7"), (1, 3, "5"),
            (2, 1, None), (2, 2, "4"),
        ],
    )
    wide = pivot_attributes(
        t.valores_campos, t.campos,
        {"texto": first("nivel", 2), "ref": reference("nivel", 2), "mayor": greatest("nivel")},
    )
    assert sorted(rows_of(wide)) == [(1, "7", 7, "9"), (2, None, None, "4")]


def test_counts_of_known_attributes(spark):
    t = tiny_tables(
        spark, campos=[(1, 2, "a"), (2, 3, "b")],
        valores_campos=[(1, 1, "x"), (1, 1, "x"), (1, 2, None), (1, 9, "x"), (2, 2, "y"), (3, 9, "z")],
    )
    assert sorted(rows_of(count_values(t.valores_campos, t.campos, "n"))) == [(1, 3), (2, 1)]
    assert rows_of(count_values(t.valores_campos, t.campos, "n", phase=2)) == [(1, 2)]


def test_reference_text_is_cast_like_an_unsigned(spark):
    cases = [("1abc", "Tecnología"), (" 2", "Ingeniería"), ("x", None), ("", None), (None, None)]
    t = tiny_tables(
        spark,
        solicitudes=[project(i) for i in range(5)],
        valores_campos=[(i, 204, text) for i, (text, _) in enumerate(cases)],
    )
    levels = project_frame(t, t.solicitudes.select("id"), levels=True).orderBy("id")
    assert column(levels, "nivel") == [name for _, name in cases]


def test_scoped_and_unscoped_attributes(spark):
    row = general_row(
        spark, valores_campos=[(1, 202, "2024-1"), (1, 305, "2023-2"), (1, 101, "Z idea"), (1, 201, "A")]
    )
    assert (row.periodo, row.titulo) == ("2024-1", "Z idea")


def test_title_falls_back_to_a_live_idea(spark):
    ideas = [project(11, 1), project(12, 1, deleted=DAY), project(13, 3), project(14, 1)]
    values = [(14, 101, "Otra idea"), (4, 201, "Propio"), (4, 301, "14")]
    for i in (1, 2, 3):
        values += [(i, 201, ""), (i, 301, str(10 + i)), (10 + i, 101, f"Idea {i}")]
    t = tiny_tables(
        spark, solicitudes=[project(i) for i in (1, 2, 3, 4)] + ideas, valores_campos=values
    )
    assert column(general_report(t), "titulo") == ["Idea 1", None, None, "Propio"]


def test_project_without_values_stays_in_the_general_report(spark):
    row = general_row(spark)
    assert (row.periodo, row.beneficiarios_icfes, row.participantes) == (None, 0, 1)
    assert row.link_repo is None


def test_json_lists_are_compared_as_text_and_counted(spark):
    row = general_row(
        spark, valores_campos=[(1, 601, '["1"]'), (1, 601, '["1","2"]'), (1, 601, "bad")]
    )
    assert row.beneficiarios_icfes == 0  # "bad" is the greatest text and no JSON
    row = general_row(spark, valores_campos=[(1, 601, '["1","2"]'), (1, 601, '["1"]')])
    assert row.beneficiarios_icfes == 1  # ']' sorts after ','


def test_dangling_second_member_is_absent(spark):
    assert general_row(spark, valores_campos=[(1, 207, "999")]).participantes == 1
    row = general_row(spark, valores_campos=[(1, 207, "2")])
    assert (row.participantes, row.nombre_est_2, row.correo_est_2) == (2, "User 2", "u2@x.edu")


def milestone(id, kind, day, number=None, deleted=None):
    return (id, 1, kind, number or f"A-{id}", day, deleted)


APPROVED, EXTENDED = "Aprobación de la propuesta", "Aplazamiento de la propuesta"


def test_first_milestone_and_deadlines(spark):
    day, other = dt.date(2024, 1, 1), dt.date(2023, 1, 1)
    row = general_row(spark, actas=[
        milestone(3, APPROVED, day), milestone(4, APPROVED, other),
        milestone(1, APPROVED, other, deleted=DAY), milestone(2, "Otra", other),
    ])
    assert (row.acta_aprobacion_propuesta, row.fecha_aprobacion_acta) == ("A-3", day)
    assert (row.fecha_minima, row.fecha_maxima) == (dt.date(2024, 3, 31), dt.date(2024, 6, 29))
    row = general_row(spark, actas=[milestone(3, APPROVED, day), milestone(4, EXTENDED, other)])
    assert row.fecha_maxima == dt.date(2024, 12, 26)
    assert row.fecha_prorroga == other


def test_milestones_without_date(spark):
    day = dt.date(2024, 1, 1)
    row = general_row(spark, actas=[milestone(1, APPROVED, None), milestone(2, APPROVED, day)])
    assert (row.acta_aprobacion_propuesta, row.fecha_aprobacion_acta) == ("A-1", None)
    assert (row.fecha_minima, row.fecha_maxima) == (None, None)
    row = general_row(spark, actas=[milestone(1, APPROVED, day), milestone(2, EXTENDED, None)])
    assert (row.acta_fecha_prorroga, row.fecha_maxima) == ("A-2", dt.date(2024, 6, 29))


def test_general_order_and_filters(spark):
    evening = dt.datetime(2024, 3, 2, 18)
    t = tiny_tables(spark, solicitudes=[
        project(1), project(2, created=evening), project(3, created=dt.datetime(2024, 3, 2)),
        project(4, estado="Fase 4"), project(5, estado=None), project(6, deleted=DAY), project(7, 5),
    ])

    def ids(**filters):
        return column(general_report(t, **filters), "id")

    assert ids() == [2, 3, 1, 4, 5]
    assert ids(estado="Fase 4") == [4]
    assert ids(estado="", fecha_inicio="") == [2, 3, 1, 4, 5]
    assert ids(fecha_inicio="2024-03-02") == [2, 3]
    assert ids(fecha_fin="2024-03-02") == [3, 1, 4, 5]  # a bare date is midnight
    assert ids(fecha_inicio="2024-03-02 00:00:01", fecha_fin="2024-03-02 23:59:59") == [2]


def test_insurance_keeps_duplicates_and_follows_phase(spark):
    t = tiny_tables(
        spark,
        solicitudes=[project(1, 5), project(2, 5, deleted=DAY), project(3, 2), project(4, 5)],
        valores_campos=[
            (1, 206, "2"), (1, 206, "2"), (1, 207, "1"), (1, 207, "999"), (1, 204, "1"),
            (2, 206, "3"), (3, 206, "3"), (4, 206, "2"),
        ],
    )
    expected = [
        ("User 1", "D1", "Tecnología", "PRINCIPAL"),
        ("User 2", "D2", "Tecnología", "PRINCIPAL"),
        ("User 2", "D2", "Tecnología", "PRINCIPAL"),
        ("User 2", "D2", None, "PRINCIPAL"),
    ]
    for spread in (False, True):
        assert rows_of(insurance_report(t, spread=spread)) == expected


def beneficiary_rows(spark, **rows):
    return rows_of(beneficiary_report(tiny_tables(spark, **rows)).select("estudiante", "titulo", "modalidad"))


def test_beneficiaries_match_string_elements_only(spark):
    cases = [
        ('["1"]', [1]), ("[1]", []), ('"1"', [1]), ('[["1"]]', [1]), ('{"a":"1"}', []), ("", []),
        ("bad", []), ('["2","1","7"]', [1, 2]), ('["01"]', []), (None, []),
    ]
    values = []
    for i, (text, _) in enumerate(cases):
        values += [(i, 206, "1"), (i, 207, "2"), (i, 601, text)]
    t = tiny_tables(spark, solicitudes=[project(1)], valores_campos=values)
    assert sorted(rows_of(beneficiaries(t))) == [
        (i, user_id) for i, (_, ids) in enumerate(cases) for user_id in ids
    ]


def test_beneficiaries_concat_with_null_is_null(spark):
    values = [(1, 206, "1"), (1, 601, '["1"]'), (1, 201, "T"), (1, 205, "1")]
    assert beneficiary_rows(spark, solicitudes=[project(1)], valores_campos=values) == [("User 1", "T", None)]
    values.append((1, 203, "C-1"))
    assert beneficiary_rows(spark, solicitudes=[project(1)], valores_campos=values) == [
        ("User 1", "T", "Pasantía - C-1")
    ]


def test_beneficiaries_merge_equal_projects(spark):
    values = []
    for p, title in [(1, "A"), (2, "B")]:
        values += [(p, 206, "1"), (p, 601, '["1"]'), (p, 201, title), (p, 301, "9")]
    found = beneficiary_rows(
        spark, solicitudes=[project(1), project(2), project(3, deleted=DAY)], valores_campos=values
    )
    assert found == [("User 1", "B", None)]


def statistics_tables(spark):
    return tiny_tables(
        spark,
        solicitudes=[
            project(1, estado="Fase 4"), project(2, estado="Rechazada"), project(3, estado=None),
            project(4, estado="Fase 1"), project(5, estado="Finalizado"),
        ],
        valores_campos=[
            (1, 202, "2024-1"), (1, 204, "1"), (1, 207, "1"), (1, 205, "1"),
            (2, 202, "2024-1"), (2, 204, "2"),
            (3, 202, "2024-1"), (3, 204, "2"), (3, 207, "77"),
            (4, 204, "1"), (4, 207, "3"),
            (5, 302, "1"),
        ],
    )


def test_semester_statistics(spark):
    cells = statistics.committee_cells(statistics_tables(spark))
    # NULL state is in no NOT IN list; project 5 has no value of its phase; 4 has no period.
    assert rows_of(statistics.by_semester(cells)) == [(None, 1, 1, 1, 0, 2), ("2024-1", 3, 1, 1, 0, 2)]
    assert rows_of(statistics.by_approval(cells)) == [
        (None, 1, 2, 0, 0, 1, 2), ("2024-1", 3, 4, 1, 2, 0, 0),
    ]
    assert rows_of(statistics.semester_text(cells)) == [
        (None, 1, "1 (1 Tecnología y 0 Ingeniería)", 2, False),
        ("2024-1", 3, "1 (1 Tecnología y 0 Ingeniería)", 2, False),
        ("TOTAL", 4, "2", 4, True),
    ]
    assert rows_of(statistics.approval_text(cells))[1] == (
        "2024-1", "3 (4 estudiantes)", "1 (Corresponde a 2 estudiantes)", "0 (Corresponde a 0 estudiantes)",
    )


def test_modality_statistics_keep_projects_without_values(spark):
    cells = statistics.committee_cells(statistics_tables(spark))
    assert rows_of(statistics.by_modality(cells)) == [(None, 1, 2, 2, 2), ("Pasantía", 1, 2, 0, 0)]
    assert rows_of(statistics.modality_rows(cells))[-1] == ("Total", 2, 4, 2, 2, True)


def test_totals_of_nothing(spark):
    t = tiny_tables(spark)
    cells = statistics.committee_cells(t)
    assert rows_of(statistics.semester_text(cells)) == [("TOTAL", 0, "0", 0, True)]
    assert rows_of(modality.hierarchy(modality.dynamics(t))) == [
        (3, None, None, "Total general", 0, 0, 0)
    ]


def professor_tables(spark):
    return tiny_tables(
        spark,
        users=[user(1, "Ana"), user(2, "Ana"), user(3, "Luis"), user(4, "Eva")],
        solicitudes=[project(i) for i in (1, 2, 3, 4, 5)] + [project(6, 1), project(7, deleted=DAY)],
        valores_campos=[
            (1, 302, "1"), (1, 202, "2024-1"), (1, 208, "x"), (1, 303, "3"),
            (2, 302, "2"), (2, 202, "2024-1"),
            (3, 302, "1"), (3, 202, "2023-2"), (3, 305, "2024-1"),
            (4, 302, "3"), (4, 305, "2999-1"),
            (5, 302, "44"), (5, 303, "4"),
            (6, 202, "2020-1"), (7, 202, "2021-1"), (7, 302, "1"),
        ],
    )


def test_periods_ignore_type_and_deletion(spark):
    assert column(professors.period_list(professor_tables(spark)), "periodo") == [
        "2020-1", "2021-1", "2023-2", "2024-1",
    ]


def test_workload_counts_values_and_merges_namesakes(spark):
    cells = professors.workload(professor_tables(spark))
    assert rows_of(professors.long_section(cells, "director")) == [
        ("Ana", "2024-1", "2023-2", 3, 1),
        ("Ana", "2024-1", "2024-1", 6, 2),
        ("Luis", "2999-1", None, 2, 1),
    ]
    assert rows_of(professors.long_section(cells, "evaluador")) == [
        ("Eva", None, None, 2, 1), ("Luis", "2024-1", "2024-1", 4, 1),
    ]


def test_matrix_keeps_the_greatest_group_and_listed_periods(spark):
    t = professor_tables(spark)
    cells, periods = professors.workload(t), ["2020-1", "2021-1", "2023-2", "2024-1"]
    directors = professors.section_matrix(cells, "director", periods).orderBy("nombre")
    assert rows_of(directors) == [("Ana", None, None, None, 6, 6), ("Luis", None, None, None, None, 0)]
    assert rows_of(professors.section_total(cells, "director", periods)) == [
        ("Total general", None, None, None, 6, 6)
    ]
    zipped = professors.zipped(cells, periods).select("fila", "director", "evaluador")
    assert rows_of(zipped) == [(1, "Ana", "Eva"), (2, "Luis", "Luis")]


def test_professor_report_in_long_form(spark):
    t = professor_tables(spark)
    long = professors.professor_report(t)
    assert rows_of(long["directores"]) == [
        ("Ana", 0, "2024-1", 6), ("Ana", 1, "Total general", 6), ("Luis", 1, "Total general", 0),
    ]
    assert rows_of(long["directores_total"]) == [
        ("Total general", 0, "2020-1", None), ("Total general", 0, "2021-1", None),
        ("Total general", 0, "2023-2", None), ("Total general", 0, "2024-1", 6),
        ("Total general", 1, "Total general", 6),
    ]
    assert rows_of(long["lado_a_lado"]) == [
        (1, 0, "2024-1", "Ana", 6, None, None), (1, 1, "Total general", "Ana", 6, "Eva", 0),
        (2, 0, "2024-1", None, None, "Luis", 4), (2, 1, "Total general", "Luis", 0, "Luis", 4),
    ]
    wide = professors.professor_report(t, ["2024-1"])
    assert rows_of(wide["directores"]) == [("Ana", 6, 6), ("Luis", None, 0)]
    assert rows_of(wide["directores_total"]) == [("Total general", 6, 6)]


def test_professor_report_with_more_than_ten_thousand_periods(spark):
    n = 10_050
    values = [v for i in range(1, n + 1) for v in ((i, 302, "1"), (i, 202, f"P {i:05d}"))]
    t = tiny_tables(spark, solicitudes=[project(i) for i in range(1, n + 1)], valores_campos=values)
    sections = professors.professor_report(t)
    rows = rows_of(sections["directores"])
    assert rows[0] == ("User 1", 0, "P 00001", 2) and rows[-1] == ("User 1", 1, "Total general", 2 * n)
    assert len(rows) == n + 1
    assert sections["directores_total"].count() == sections["lado_a_lado"].count() == n + 1


def block_rows(frame, *keys):
    """The filled cells of a block section."""
    places = [c for c in frame.columns if "p_0" in c or c.endswith("total_general")]
    return [(*[r[k] for k in keys], {c: r[c] for c in places if r[c] is not None}) for r in frame.collect()]


def test_professor_report_in_blocks(spark):
    sections = professors.professor_report(professor_tables(spark), ancho=3)
    assert rows_of(sections["periodos"]) == [("2020-1", 1, 1), ("2021-1", 1, 2), ("2023-2", 1, 3), ("2024-1", 2, 1)]
    assert block_rows(sections["directores"], "nombre", "bloque") == [
        ("Ana", 1, {"total_general": 6}), ("Ana", 2, {"p_001": 6}), ("Luis", 1, {"total_general": 0}),
    ]
    assert block_rows(sections["directores_total"], "nombre", "bloque") == [
        ("Total general", 1, {"total_general": 6}), ("Total general", 2, {"p_001": 6}),
    ]
    assert block_rows(sections["lado_a_lado"], "fila", "bloque", "director", "evaluador") == [
        (1, 1, "Ana", "Eva", {"director_total_general": 6, "evaluador_total_general": 0}),
        (1, 2, "Ana", None, {"director_p_001": 6}),
        (2, 1, "Luis", "Luis", {"director_total_general": 0, "evaluador_total_general": 4}),
        (2, 2, None, "Luis", {"evaluador_p_001": 4}),
    ]
    assert sections["directores"].schema["p_001"].metadata["group"] == professors.GROUP


ODD_PERIODS = ["Nombre", "bloque", "nombre", "p_001", "total_general", "Total general", "a`b", "á.b"]


def test_periods_may_be_called_like_columns(spark):
    values = [v for i, p in enumerate(ODD_PERIODS, 1) for v in ((i, 302, "1"), (i, 303, "2"), (i, 202, p))]
    t = tiny_tables(spark, solicitudes=[project(i) for i in range(1, 9)], valores_campos=values)
    listed = sorted(ODD_PERIODS)
    wide = professors.professor_report(t, periodos=listed)
    for section, person in (("directores", "User 1"), ("evaluadores", "User 2")):
        assert rows_of(wide[section]) == [(person, *[3] * 8, 24)]
        assert [f.metadata["label"] for f in wide[section].schema][1:-1] == listed
    assert rows_of(wide["directores_total"]) == [("Total general", *[3] * 8, 24)]
    assert wide["lado_a_lado"].count() == 1
    long = professors.professor_report(t)
    assert rows_of(long["directores"]) == [*[("User 1", 0, p, 3) for p in listed], ("User 1", 1, "Total general", 24)]
    blocks = professors.professor_report(t, ancho=5)
    assert block_rows(blocks["directores"], "bloque") == [
        (1, {**{f"p_00{i}": 3 for i in range(1, 6)}, "total_general": 24}), (2, {f"p_00{i}": 3 for i in range(1, 4)}),
    ]


def test_reports_without_periods_or_people(spark):
    nobody = tiny_tables(spark, valores_campos=[(1, 202, "2024-1")])
    assert rows_of(professors.professor_report(nobody)["directores_total"]) == [
        ("Total general", 0, "2024-1", None), ("Total general", 1, "Total general", None),
    ]
    assert professors.professor_report(nobody)["lado_a_lado"].isEmpty()
    never = tiny_tables(spark, solicitudes=[project(1)], valores_campos=[(1, 302, "1")])
    assert rows_of(professors.professor_report(never)["directores"]) == [("User 1", 1, "Total general", 0)]
    assert block_rows(professors.professor_report(never, ancho=2)["directores"], "nombre") == [("User 1", {"total_general": 0})]


def test_twenty_thousand_periods_in_blocks(spark, tmp_path):
    """Written and read again: no period is a column, and no list of them reaches the driver."""
    n = 20_000
    values = [v for i in range(1, n + 1) for v in ((i, 302, "1"), (i, 202, f"P {i:05d}"))]
    t = tiny_tables(spark, solicitudes=[project(i) for i in range(1, n + 1)], valores_campos=values)
    export_report(spark, "dinamica_profesores_report", t, str(tmp_path), "x", ancho=40)
    back = read_report(spark, str(tmp_path), "dinamica_profesores_report", "x")
    rows = back["directores"].collect()
    assert [r.bloque for r in rows] == list(range(1, 501)) and rows[0].total_general == 2 * n
    assert all(r[f"p_{i:03d}"] == 2 for r in rows for i in range(1, 41))
    assert back["periodos"].count() == n and back["directores_total"].count() == 500


def test_beneficiaries_are_in_order_of_level_and_name(spark):
    people = [user(1, "Zoe"), user(2, "Ana"), user(3, "Ana"), user(4, "Luis")]
    values = []
    for p, (member, level) in enumerate([(1, "1"), (2, "2"), (3, "1"), (4, None)], 1):
        values += [(p, 206, str(member)), (p, 601, f'["{member}"]'), *([(p, 204, level)] if level else [])]
    t = tiny_tables(spark, users=people, solicitudes=[project(i) for i in range(1, 5)], valores_campos=values)
    shown = [(r.programa, r.estudiante) for r in beneficiary_report(t).collect()]
    assert shown == [(None, "Luis"), ("Ingeniería", "Ana"), ("Tecnología", "Ana"), ("Tecnología", "Zoe")]


def test_modality_hierarchy_tells_null_modality_from_subtotal(spark):
    t = tiny_tables(
        spark,
        solicitudes=[project(1, estado="Fase 4"), project(2), project(3, estado="Fase 5"), project(4)],
        valores_campos=[
            (1, 202, "2024-1"), (1, 205, "1"), (2, 202, "2024-1"), (3, 202, "2024-1"), (3, 205, "1"),
            (4, 204, "1"),
        ],
    )
    rows = modality.dynamics(t)
    assert rows_of(modality.hierarchy(rows)) == [
        (1, None, None, None, 1, 0, None),
        (0, None, None, None, 1, 0, None),
        (1, "2024-1", None, "2024-1", 3, 2, 2),
        (0, "2024-1", "Pasantía", "Pasantía", 2, 2, 2),
        (0, "2024-1", None, None, 1, 0, None),
        (3, None, None, "Total general", 4, 2, 2),
    ]
    nested = {r.periodo: [tuple(x) for x in r.filas] for r in modality.nested(rows).collect()}
    assert nested == {None: [(None, 1, 0)], "2024-1": [("Pasantía", 2, 2), (None, 1, 0)]}


def test_labelled_projection(spark):
    frame = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 1, 2))],
        "id int, momento timestamp_ntz, dia date",
    )
    shown = labelled(frame, [("Cuándo", "momento"), ("Día", "dia"), ("Día", "falta")])
    assert rows_of(shown) == [("2024-01-02 03:04:05", dt.date(2024, 1, 2), None)]
    assert [f.metadata["label"] for f in shown.schema] == ["Cuándo", "Día", "Día"]


def test_column_widths(spark):
    frame = spark.createDataFrame(
        [("abcdefgh", 0, None), ("x" * 60, 12345, None)], "texto string, numero int, vacio string"
    )
    shown = labelled(frame, [("T", "texto"), ("N", "numero"), ("Vacío", "vacio")])
    assert rows_of(column_widths(shown)) == [("texto", 40), ("numero", 7), ("vacio", 7)]
    assert rows_of(column_widths(shown.filter("false"), cap=5))[2] == ("vacio", 5)


def test_export_has_every_column(spark):
    t = tiny_tables(spark, solicitudes=[project(1)])
    assert labelled(general_report(t), EXPORT).columns == [key for _, key in EXPORT]


def test_references_are_the_least_attribute_then_id(spark):
    """Ids of any size, NULL first, attribute ids in order also below 0."""
    big = 2**62
    values = {
        1: [(1, "10"), (1, "9")], 2: [(1, None), (1, "5")], 3: [(2, "3"), (1, str(big))], 4: [(1, str(big)), (1, str(big - 1))],
        5: [(2, str(big)), (1, "4")], 6: [(1, str(2**32 - 2)), (1, str(2**32 - 1))], 7: [(1, str(2**32)), (1, str(2**32 - 1))],
        8: [(-5, "8"), (1, "2")], 9: [(1, "x"), (1, "7")], 10: [(-5, str(big)), (-5, str(big + 1)), (1, "1")], 11: [(3, "6")],
        12: [(2, None), (1, str(big))], 13: [(1, str(2**63 - 1))],
    }
    t = tiny_tables(
        spark, campos=[(1, 2, "r"), (2, 2, "r"), (-5, 2, "r"), (3, 2, "other")],
        valores_campos=[(p, c, v) for p, rows in values.items() for c, v in rows],
    )
    wide = pivot_attributes(t.valores_campos, t.campos, {"r": reference("r", 2), "t": greatest("other")})
    wanted = [9, None, big, big - 1, 4, 2**32 - 2, 2**32 - 1, 8, 0, big, None, big, 2**63 - 1]
    assert {r.solicitud_id: r.r for r in wide.collect()} == dict(enumerate(wanted, 1))


@pytest.mark.parametrize("broadcast_people", [True, False])
def test_people_in_every_role(spark, broadcast_people):
    t = tiny_tables(
        spark,
        solicitudes=[project(1), project(2)],
        valores_campos=[(1, 302, "1"), (1, 303, "1"), (1, 206, "2"), (1, 207, "2x"), (2, 304, "5")],
    )
    roles = {"director": ("name",), "evaluador": ("name", "email"), "codirector": ("name",),
             "integrante_2": ("name",)}
    frame = project_frame(
        t, t.solicitudes.select("id"), people=roles, broadcast_people=broadcast_people
    ).orderBy("id")
    names = ["id", *[f"{r}_name" for r in roles], "evaluador_email", "integrante_2_ok"]
    assert rows_of(frame.select(*names)) == [
        (1, "User 1", "User 1", None, "User 2", "u1@x.edu", 2),
        (2, None, None, "User 5", None, None, None),
    ]
    assert frame.filter(F.col("director_ok") == 1).count() == 1
