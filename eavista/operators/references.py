"""Attribute references resolved to ideas, people and catalog entries.

Catalog entries join after the pivot; Spark broadcasts them by size. People do
too while their table is under the broadcast threshold. Ideas, and people beyond
the threshold, are looked up with narrow (project, id) rows and come back keyed
by project, so the wide project rows are never shuffled for a lookup.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from eavista.operators.attributes import (
    Attribute,
    count_values,
    greatest,
    pivot_attributes,
    reference,
)
from eavista.operators.chosen import Chosen, choose
from eavista.operators.filters import projects_of
from eavista.operators.skew import spread_join
from eavista.sources.shared import fits_broadcast, written
from eavista.sources.tables import Tables

# The attribute that names each person's role, and its phase.
ROLES = {
    "director": reference("director_id", 3),
    "evaluador": reference("evaluador_id", 3),
    "codirector": reference("codirector_id", 3),
    "integrante_1": reference("id_integrante_1", 2),
    "integrante_2": reference("id_integrante_2", 2),
}
LEVEL = reference("nivel", 2)
MODALITY = reference("modalidad", 2)
IDEA = reference("idea_banco", 3)
IDEA_PROJECT_TYPE = 1


def attach_catalog(projects: DataFrame, ref: str, catalog: DataFrame, name: str) -> DataFrame:
    """Left join of a catalog on a reference column: adds ``<name>_ok`` id and ``name``."""
    entries = catalog.select(
        F.col("id").cast("bigint").alias(f"{name}_ok"), F.col("nombre").alias(name)
    )
    return projects.join(entries, F.col(ref) == F.col(f"{name}_ok"), "left")


def idea_titles(tables: Tables, linked: Chosen | None = None) -> DataFrame:
    """Live ideas with any idea-phase value, and their title; of the ``linked`` ones alone if given."""
    ideas = projects_of(tables.solicitudes, IDEA_PROJECT_TYPE).select(F.col("id").alias("idea_id"))
    titles = pivot_attributes(
        _sifted(tables.valores_campos, linked),
        tables.campos,
        {"titulo_idea": greatest("titulo", IDEA_PROJECT_TYPE)},
    ).withColumnRenamed("solicitud_id", "idea_id")
    return ideas.join(titles, "idea_id")


def linked_idea_titles(tables: Tables, spread: bool = True, chosen: Chosen | None = None) -> DataFrame:
    """(project, title of its idea) for the projects whose idea is live.

    Of chosen projects, only the ideas that they link to are read.
    """
    values = _sifted(tables.valores_campos, chosen)
    links = pivot_attributes(values, tables.campos, {"idea_id": IDEA}).filter(F.col("idea_id").isNotNull())
    linked = None
    if chosen is not None:
        links = written(links)
        linked = choose(links.select(F.col("idea_id").alias("id")).distinct())
    titles = idea_titles(tables, linked)
    if spread:
        found = spread_join(links, titles, "idea_id", spread_on="solicitud_id", kept=chosen is not None)
    else:
        found = links.join(titles, "idea_id")
    return found.select("solicitud_id", "titulo_idea")


def _sifted(values: DataFrame, chosen: Chosen | None, key: str = "solicitud_id") -> DataFrame:
    return values if chosen is None else chosen.rows(values, key)


def people_by_project(
    tables: Tables, roles: Mapping[str, Sequence[str]], chosen: Chosen | None = None
) -> DataFrame:
    """(project, ``<role>_ok`` user id, ``<role>_<field>``...) through one join for all roles."""
    specs = {role: ROLES[role] for role in roles}
    needed = sorted({field for wanted in roles.values() for field in wanted})
    picked = pivot_attributes(_sifted(tables.valores_campos, chosen), tables.campos, specs)
    named = [F.struct(F.lit(role).alias("rol"), F.col(role).alias("usuario_id")) for role in roles]
    long = (
        picked.select("solicitud_id", F.explode(F.array(*named)).alias("p"))
        .select("solicitud_id", "p.rol", "p.usuario_id")
        .filter(F.col("usuario_id").isNotNull())
    )
    users = tables.users.select(F.col("id").alias("usuario_id"), *needed)
    found = long.join(users, "usuario_id")
    columns = []
    for role, wanted in roles.items():
        mine = F.col("rol") == role
        columns.append(F.max(F.when(mine, F.col("usuario_id"))).alias(f"{role}_ok"))
        columns += [F.max(F.when(mine, F.col(f))).alias(f"{role}_{f}") for f in wanted]
    return found.groupBy("solicitud_id").agg(*columns)


def people_columns(roles: Mapping[str, Sequence[str]]) -> dict[str, Attribute]:
    """The pivot columns that ``attach_people`` needs."""
    return {f"{role}_ref": ROLES[role] for role in roles}


def attach_people(
    projects: DataFrame, users: DataFrame, roles: Mapping[str, Sequence[str]]
) -> DataFrame:
    """One left join of ``users`` per role, on the role's reference column."""
    for role, wanted in roles.items():
        person = users.select(
            F.col("id").alias(f"{role}_ok"), *[F.col(f).alias(f"{role}_{f}") for f in wanted]
        )
        projects = projects.join(person, F.col(f"{role}_ref") == F.col(f"{role}_ok"), "left")
    return projects


def project_frame(
    tables: Tables,
    projects: DataFrame,
    attributes: Mapping[str, Attribute] | None = None,
    levels: bool = False,
    modalities: bool = False,
    people: Mapping[str, Sequence[str]] | None = None,
    idea_title: bool = False,
    counts: Mapping[str, int | None] | None = None,
    beside: Sequence[DataFrame] = (),
    broadcast_people: bool | None = None,
    chosen: Chosen | None = None,
) -> DataFrame:
    """``projects`` with their attributes and resolved references, one row per project.

    ``counts`` names columns for the number of values of a phase, or of any
    (None). Everything keyed by project (the pivot, the counts, idea titles,
    people beyond the broadcast threshold, and the frames in ``beside``) joins on
    one partitioning by project id. ``chosen`` are the projects' ids, where they are
    few: then only rows of these are aggregated and shuffled.
    """
    values = _sifted(tables.valores_campos, chosen)
    people = people or {}
    specs = dict(attributes or {})
    if levels:
        specs["nivel_ref"] = LEVEL
    if modalities:
        specs["modalidad_ref"] = MODALITY
    small = fits_broadcast(tables.users) if broadcast_people is None else broadcast_people
    if people and small:
        specs |= people_columns(people)
    keyed = list(beside)
    if specs:
        keyed.append(pivot_attributes(values, tables.campos, specs))
    for column, phase in (counts or {}).items():
        keyed.append(count_values(values, tables.campos, column, phase))
    if people and not small:
        keyed.append(people_by_project(tables, people, chosen))
    if idea_title:
        keyed.append(linked_idea_titles(tables, chosen=chosen))
    for frame in keyed:
        projects = projects.join(frame.withColumnRenamed("solicitud_id", "id"), "id", "left")
    if levels:
        projects = attach_catalog(projects, "nivel_ref", tables.niveles, "nivel")
    if modalities:
        projects = attach_catalog(projects, "modalidad_ref", tables.modalidades, "modalidad")
    if people and small:
        projects = attach_people(projects, tables.users, people)
    return projects
