"""Small literal tables for the semantic cases."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa

from eavista.sources.tables import Tables
from verification.fixtures import ATTRIBUTES, TYPES

MOMENT = pa.timestamp("us")
TYPES_OF = {
    "solicitudes": {
        "id": pa.int64(), "tipo_solicitud_id": pa.int32(), "estado": pa.string(),
        "created_at": MOMENT, "deleted_at": MOMENT,
    },
    "valores_campos": {"solicitud_id": pa.int64(), "campo_id": pa.int32(), "valor": pa.string()},
    "campos": {"id": pa.int32(), "tipo_solicitud_id": pa.int32(), "name": pa.string()},
    "users": {
        "id": pa.int64(), "name": pa.string(), "nro_documento": pa.string(),
        "nro_celular": pa.string(), "email": pa.string(),
    },
    "niveles": {"id": pa.int32(), "nombre": pa.string()},
    "modalidades": {"id": pa.int32(), "nombre": pa.string()},
    "tipos_solicitudes": {"id": pa.int32(), "nombre": pa.string()},
    "actas": {
        "id": pa.int64(), "proyecto_id": pa.int64(), "descripcion": pa.string(),
        "numero": pa.string(), "fecha": pa.date32(), "deleted_at": MOMENT,
    },
}
DAY = dt.datetime(2024, 3, 1)


def project(id, kind=2, estado="Fase 1", created=DAY, deleted=None):
    return (id, kind, estado, created, deleted)


def user(id, name=None):
    return (id, name or f"User {id}", f"D{id}", f"3{id}", f"u{id}@x.edu")


def tiny_tables(spark, **rows) -> Tables:
    rows = {
        "campos": ATTRIBUTES,
        "tipos_solicitudes": TYPES,
        "niveles": [(1, "Tecnología"), (2, "Ingeniería")],
        "modalidades": [(1, "Pasantía"), (2, "Monografía")],
        "users": [user(i) for i in range(1, 6)],
        **rows,
    }

    def table(name):
        kinds = TYPES_OF[name]
        columns = list(zip(*rows[name])) if rows.get(name) else [[] for _ in kinds]
        arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds.values())]
        return spark.createDataFrame(pa.table(arrays, names=list(kinds)))

    return Tables.load(table)


def rows_of(frame) -> list[tuple]:
    return [tuple(row) for row in frame.collect()]


def column(frame, name: str) -> list:
    return [row[name] for row in frame.collect()]
