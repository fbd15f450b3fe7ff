"""The eight tables derived from the given parquet files (rules: FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eavista.sources.tables import Tables

# Fixed values: (campos.id, phase, name).
ATTRIBUTES = [
    (101, 1, "titulo"),
    (201, 2, "titulo"),
    (202, 2, "periodo"),
    (203, 2, "codigo_modalidad"),
    (204, 2, "nivel"),
    (205, 2, "modalidad"),
    (206, 2, "id_integrante_1"),
    (207, 2, "id_integrante_2"),
    (208, 2, "objetivo"),
    (209, 2, "descripcion"),
    (301, 3, "idea_banco"),
    (302, 3, "director_id"),
    (303, 3, "evaluador_id"),
    (304, 3, "codirector_id"),
    (305, 3, "periodo"),
    (601, 6, "beneficiarios_icfes"),
]

# Project types.
TYPES = [
    (1, "Idea"),
    (2, "Fase 0"),
    (3, "Fase 1"),
    (4, "Fase 2"),
    (5, "Fase 3"),
    (6, "Fase 4"),
    (7, "Fase 5"),
]

# States by order priority, and milestone kinds by return flag.
STATES = {
    "1-URGENT": "Fase 1",
    "2-HIGH": "Fase 4",
    "3-MEDIUM": "Fase 5",
    "4-NOT SPECIFIED": "Finalizado",
    "5-LOW": "Rechazada",
}
KINDS = {
    "A": "Aprobación de la propuesta",
    "N": "Aprobación del informe final",
    "R": "Aplazamiento de la propuesta",
}


def derived_tables(spark: SparkSession, sf_dir: str) -> Tables:
    def given(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders = given("orders")
    made = {
        "solicitudes": _projects(orders),
        "valores_campos": _values(orders),
        "campos": _literal(spark, ATTRIBUTES, "id, tipo_solicitud_id, name"),
        "users": _users(given("customer")),
        "niveles": given("region").selectExpr("r_regionkey + 1 AS id", "r_name AS nombre"),
        "modalidades": given("nation").selectExpr("n_nationkey + 1 AS id", "n_name AS nombre"),
        "tipos_solicitudes": _literal(spark, TYPES, "id, nombre"),
        "actas": _milestones(given("lineitem")),
    }
    return Tables.load(made.__getitem__)


def _literal(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """An inline table, whose size Spark knows."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({columns})")


def _choice(column: str, choices: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for value, text in choices.items():
        out = F.when(F.col(column) == value, text).otherwise(out)
    return out


def _projects(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        (k + 1).alias("id"),
        F.when(k % 10 <= 1, 1).when(k % 10 == 8, 5).otherwise(2).alias("tipo_solicitud_id"),
        F.when(k % 97 != 0, _choice("o_orderpriority", STATES)).alias("estado"),
        F.col("o_orderdate").alias("created_at"),
        F.when((k % 20).isin(10, 19), F.col("o_orderdate")).alias("deleted_at"),
    )


def _users(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.select(
        (key + 1).alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("D"), key).alias("nro_documento"),
        F.concat(F.lit("3"), key).alias("nro_celular"),
        F.concat("c_name", F.lit("@x.edu")).alias("email"),
    )


def _values(orders: DataFrame) -> DataFrame:
    """One scan of the orders; every order gives its value rows as an array."""
    k, date = F.col("o_orderkey"), F.col("o_orderdate")
    idea = k % 10 <= 1
    formal = ~idea
    first, second = F.col("o_custkey") + 1, F.col("o_custkey") + 2

    def text(prefix: str, number: Column) -> Column:
        return F.concat(F.lit(prefix), number.cast("string"))

    def row(campo: int, keep: Column, valor: Column) -> Column:
        return F.when(
            keep, F.struct(F.lit(campo).alias("campo_id"), valor.cast("string").alias("valor"))
        )

    term = F.when(F.month(date) <= 6, "-1").otherwise("-2")
    listed = (
        F.when(k % 4 == 0, F.concat(F.lit('["'), first, F.lit('","'), second, F.lit('"]')))
        .when(k % 4 == 1, F.concat(F.lit('["'), first, F.lit('"]')))
        .otherwise(F.concat(F.lit("["), first, F.lit("]")))
    )
    rows = [
        row(101, idea, text("Idea ", k)),
        row(201, formal, F.when(k % 3 == 0, "").otherwise(text("Titulo ", k))),
        row(202, formal & (k % 50 != 2), F.concat(F.year(date).cast("string"), term)),
        row(203, formal & (k % 7 != 0), text("C-", k)),
        row(204, formal, F.when(k % 41 == 0, "abc").otherwise((k % 3 + 1).cast("string"))),
        row(204, formal & (k % 29 == 0), F.lit("2")),
        row(205, formal & (k % 13 != 0), k % 25 + 1),
        row(206, formal, first),
        row(207, formal & (k % 2 == 0),
            F.when(k % 17 == 0, "999999999").otherwise(second.cast("string"))),
        row(208, formal, F.lit("obj")),
        row(209, formal, F.concat(F.lit("obs "), "o_orderpriority")),
        row(301, formal, k - k % 10 + 1),
        row(302, formal, k % 40 + 1),
        row(303, formal & (k % 11 != 0), k % 30 + 1),
        row(304, formal & (k % 5 == 0), k % 20 + 1),
        row(305, formal & (k % 40).isin(5, 12, 23),
            F.when(k % 40 == 23, "2999-1").otherwise("2001-1")),
        row(601, formal & (k % 4 != 3), listed),
    ]
    return (
        orders.select((k + 1).alias("solicitud_id"), F.explode(F.array(*rows)).alias("v"))
        .filter(F.col("v").isNotNull())
        .select("solicitud_id", "v.campo_id", "v.valor")
    )


def _milestones(lineitem: DataFrame) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    position = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return lineitem.select(
        (position * 2**24 + cents).alias("id"),
        (F.col("l_orderkey") + 1).alias("proyecto_id"),
        _choice("l_returnflag", KINDS).alias("descripcion"),
        F.concat(F.lit("A-"), "l_partkey").alias("numero"),
        F.col("l_shipdate").cast("date").alias("fecha"),
        F.when(F.col("l_linenumber") == 7, F.col("l_shipdate")).alias("deleted_at"),
    )
