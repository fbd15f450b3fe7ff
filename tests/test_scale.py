"""Plans and the ways around skew and large tables."""

import pytest
from pyspark.sql import functions as F

from eavista.operators import chosen, ranking, skew
from eavista.operators.attributes import greatest, pivot_attributes, reference
from eavista.operators.references import (
    ROLES,
    linked_idea_titles,
    people_by_project,
    project_frame,
)
from eavista.operators.skew import spread_join, with_hot_keys
from eavista.plans import general, insurance, modality, professors, statistics
from eavista.plans.beneficiaries import beneficiary_report
from eavista.sources.tables import read_files, write_files
from tests.tiny import project, tiny_tables


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def same_rows(left, right) -> bool:
    columns = [F.col(f"`{c}`") for c in left.columns]
    left, right = left.select(columns), right.select(columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_spread_join_equals_join(spark):
    many = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    one = spark.range(5, 60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for kept in (False, True):
        _, hot = with_hot_keys(many, "k", 100, kept)
        assert list(hot.values()) == [11] and list(hot) == [spark.range(7, 8).select(F.xxhash64("id")).first()[0]]
        spread = spread_join(many, one, "k", spread_on="id", rows_per_slice=100, kept=kept)
        assert same_rows(many.join(one, "k"), spread)
    nobody = many.filter("id < 0")
    assert spread_join(nobody, one, "k", spread_on="id").isEmpty()


def test_rows_are_computed_once_for_keys_and_join(spark):
    """The hot keys come from the job that writes the rows; the join reads what was written."""
    computed = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            computed.add(len(batch))
            yield batch

    many = spark.range(1000).select((F.col("id") % 2).alias("k"), "id").mapInArrow(seen, "k long, id long")
    one = spark.range(2).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    joined = spread_join(many, one, "k", spread_on="id", rows_per_slice=100)
    assert joined.count() == 1000 and computed.value == 1000
    assert "MapInArrow" not in plan_of(joined) and "tramo" in plan_of(joined)


def test_a_hot_key_reaches_many_tasks(spark, settings):
    settings({
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "4",
    })
    many = spark.range(20000).select(F.when(F.col("id") < 30000, 1).otherwise(2).alias("k"), "id")
    one = spark.range(1, 2).select(F.col("id").alias("k"), F.lit(2).alias("w"))

    def sizes(joined):
        return [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]

    assert sizes(many.join(one, "k")) == [20000]
    spread = sizes(spread_join(many, one, "k", spread_on="id", rows_per_slice=500))
    assert sum(spread) == 20000 and len(spread) == 4 and max(spread) < 12000


def test_counted_rows_decide_at_any_size(spark, monkeypatch):
    projects = [project(i) for i in range(1, 301)] + [project(900, 1)]
    values = [(i, 301, "900") for i in range(1, 301)] + [(900, 101, "Idea")]
    t = tiny_tables(spark, solicitudes=projects, valores_campos=values)
    assert "tramo" not in plan_of(linked_idea_titles(t))
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 100)
    found = linked_idea_titles(t)
    assert "tramo" in plan_of(found)
    assert sorted(tuple(r) for r in found.collect()) == [(i, "Idea") for i in range(1, 301)]


def test_spread_and_large_people_paths_give_the_same_reports(tables):
    assert same_rows(linked_idea_titles(tables, spread=False), linked_idea_titles(tables, spread=True))
    assert same_rows(
        insurance.insurance_report(tables, spread=False), insurance.insurance_report(tables, spread=True)
    )
    assert same_rows(
        beneficiary_report(tables, spread=False, broadcast_people=True),
        beneficiary_report(tables, spread=True, broadcast_people=False),
    )
    assert same_rows(
        general.general_report(tables, broadcast_people=True),
        general.general_report(tables, broadcast_people=False),
    )


def test_people_use_one_join_for_all_roles(spark, tables):
    roles = {role: ("name",) for role in ROLES}
    plan = plan_of(people_by_project(tables, roles))
    assert plan.count("customer.parquet") == 1
    projects = tables.solicitudes.select("id")
    many = plan_of(project_frame(tables, projects, people=roles, broadcast_people=False))
    assert many.count("customer.parquet") == 1


def test_references_reduce_by_hash(tables):
    for wanted in ({"levels": True}, {"modalities": True}, {"people": {"director": ("name",)}}):
        plan = plan_of(project_frame(tables, tables.solicitudes.select("id"), **wanted))
        assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("wanted", [1, 62, 63, 200])
def test_any_number_of_attributes(spark, wanted):
    campos = [(i, 2, f"a{i}") for i in range(250)]
    values = [(p, i, str(1000 * p + i)) for p in (1, 2) for i in range(250) if (i + p) % 7]
    t = tiny_tables(spark, campos=campos, valores_campos=values)
    specs = {f"c{i}": (reference if i % 2 else greatest)(f"a{i}") for i in range(wanted)}
    found = {r.solicitud_id: r for r in pivot_attributes(t.valores_campos, t.campos, specs).collect()}
    for p in (1, 2):
        for i in range(wanted):
            number = 1000 * p + i if (i + p) % 7 else None
            assert found[p][f"c{i}"] == (number if i % 2 else number and str(number)) if p in found else number is None


@pytest.mark.parametrize("limit", [10**6, 0])
def test_chosen_rows_are_held_back(spark, limit):
    """By ids, or by a bitmap that lets few others through."""
    ids = spark.range(0, 30000, 3)
    picked = chosen.choose(ids, limit)
    assert picked.count == 10000 and bool(picked.bits) == (limit == 0)
    rows = spark.range(60000).select(F.col("id").alias("k"), F.lit("t").alias("mapa_"), "id")
    kept = picked.rows(rows, "k")
    found = {r.k for r in kept.collect()}
    assert kept.columns == rows.columns and set(range(0, 30000, 3)) <= found
    assert len(found) == 10000 if limit else len(found) < 10000 + 50000 * 0.08
    assert picked.rows(rows.filter("id < 0"), "k").isEmpty()
    assert chosen.choose(ids.filter("id < 0"), limit).rows(rows, "k").isEmpty()


def test_bitmap_sifts_by_semi_join(spark):
    """Rows meet the bitmap in a semi join, and its test of a row reads a number, no text."""
    ids = spark.range(0, 90_000, 9)
    kept = chosen.choose(ids, 0).rows(spark.range(90_000).withColumnRenamed("id", "k"), "k")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "conv(" not in plan and "hex(" not in plan
    found = {r.k for r in kept.collect()}
    assert found >= set(range(0, 90_000, 9)) and len(found) < 20_000


@pytest.mark.parametrize("limit", [None, 0])
def test_filtered_report_reads_the_chosen_projects_values(spark, stored, monkeypatch, limit):
    """Values, milestones, links and titles of others do not reach the aggregations."""
    choose, sifted = chosen.choose, []

    def watched(ids, _=None):
        found = choose(ids, limit)
        rows = found.rows
        object.__setattr__(found, "rows", lambda frame, key: sifted.append((rows(frame, key), frame)) or sifted[-1][0])
        return found

    monkeypatch.setattr(general, "choose", watched)
    monkeypatch.setattr("eavista.operators.references.choose", watched)
    filters = {"estado": "Fase 4", "fecha_inicio": "1996-03-01"}
    report = general.general_report(stored, **filters)
    everything = general.general_report(stored)
    ids = {r.id for r in report.select("id").collect()}
    assert 0 < len(ids) < everything.count() / 4
    assert same_rows(report, everything.filter(F.col("id").isin(list(ids))))
    assert len(sifted) == 4
    for rows, frame in sifted:
        assert rows.count() < frame.count() * (0.2 if limit is None else 0.3)
    if limit is None:
        plan = plan_of(report)
        assert plan.count("LeftSemi") >= 3 and "CartesianProduct" not in plan


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_positions_without_one_sorted_task(spark, settings, partitions):
    settings({"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    names = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
        F.when(F.col("id") > 1, F.sha1(F.col("id").cast("string"))).alias("n"),
    ).distinct()
    # a name that many rows share, in a group that holds most of them
    names = names.union(spark.range(200).select(F.lit("b"), F.lit("7777")))
    placed = ranking.with_position(names, "g", "n").collect()
    for group in "ab":
        mine = sorted((r for r in placed if r.g == group), key=lambda r: r.fila)
        ordered = sorted((r.n for r in mine), key=lambda n: (n is not None, n))
        assert [r.n for r in mine] == ordered
        assert [r.fila for r in mine] == list(range(1, len(mine) + 1))
    assert ranking.with_position(names.filter("g = 'c'"), "g", "n").isEmpty()


REPORTS = {
    "general": general.general_report,
    "insurance": insurance.insurance_report,
    "beneficiaries": beneficiary_report,
    "semester": lambda t: statistics.by_semester(statistics.committee_cells(t)),
    "workload": professors.workload,
    "modality": modality.modality_report,
}


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "stored")
    write_files(tables, path)
    return read_files(spark, path)


@pytest.mark.parametrize("name", REPORTS)
def test_plans_stay_in_spark_and_prune(stored, name):
    plan = plan_of(REPORTS[name](stored))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Window"):
        assert unwanted not in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    values = [line for line in scans if "valores_campos" in line]
    assert values
    # values are read of the wanted attributes only, or without their text
    assert all("dynamicpruning" in line or "valor#" not in line for line in values)
    for line in scans:
        if "solicitudes]" in line and "tipos_solicitudes" not in line and name != "beneficiaries":
            assert "tipo_solicitud_id" in line.split("PartitionFilters")[1]


@pytest.mark.parametrize("name", ["general", "semester", "workload", "modality"])
def test_projects_values_and_milestones_shuffle_once(stored, name):
    """One exchange per input on the project id; the joins add none."""
    plan = plan_of(REPORTS[name](stored))
    by_project = [
        line for line in plan.splitlines()
        if "Exchange hashpartitioning" in line and ("(id#" in line or "solicitud_id#" in line or "proyecto_id#" in line)
    ]
    # projects, pivoted values and counted values; general: projects, values,
    # milestones, idea references, idea titles, linked titles
    assert len(by_project) <= {"general": 6}.get(name, 3)


@pytest.mark.parametrize("name", ["semester", "workload", "modality"])
def test_counting_values_reads_no_text(stored, name):
    scans = [line for line in plan_of(REPORTS[name](stored)).splitlines() if "valores_campos" in line]
    assert any("valor#" not in line for line in scans if "FileScan" in line)


def test_stored_tables_give_the_same_reports(tables, stored):
    for name in ("beneficiaries", "workload", "modality"):
        assert same_rows(REPORTS[name](tables), REPORTS[name](stored))
