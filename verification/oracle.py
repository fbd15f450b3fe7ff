"""DuckDB SQL for every query, written without correlated subqueries.

Each text inlines the derived tables it uses as CTEs over the given views. A
reference lookup is a ``row_number`` per (project, attribute, phase), so that it
shares no construction with the Spark side.
"""

from __future__ import annotations

import re

# Periods in a row of the block form, as the queries ask for it.
WIDTH = 8
PLACES = [f"p_{i:03d}" for i in range(1, WIDTH + 1)]

CTES: dict[str, str] = {
    "solicitudes": """
        SELECT o_orderkey + 1 AS id,
          CAST(CASE WHEN o_orderkey % 10 IN (0, 1) THEN 1 WHEN o_orderkey % 10 = 8 THEN 5 ELSE 2 END AS INTEGER)
            AS tipo_solicitud_id,
          CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CASE o_orderpriority
            WHEN '1-URGENT' THEN 'Fase 1' WHEN '2-HIGH' THEN 'Fase 4' WHEN '3-MEDIUM' THEN 'Fase 5'
            WHEN '4-NOT SPECIFIED' THEN 'Finalizado' WHEN '5-LOW' THEN 'Rechazada' END END AS estado,
          o_orderdate AS created_at,
          CASE WHEN o_orderkey % 20 IN (10, 19) THEN o_orderdate END AS deleted_at
        FROM orders""",
    "campos": """
        SELECT * FROM (VALUES (101, 1, 'titulo'), (201, 2, 'titulo'), (202, 2, 'periodo'),
          (203, 2, 'codigo_modalidad'), (204, 2, 'nivel'), (205, 2, 'modalidad'),
          (206, 2, 'id_integrante_1'), (207, 2, 'id_integrante_2'), (208, 2, 'objetivo'),
          (209, 2, 'descripcion'), (301, 3, 'idea_banco'), (302, 3, 'director_id'),
          (303, 3, 'evaluador_id'), (304, 3, 'codirector_id'), (305, 3, 'periodo'),
          (601, 6, 'beneficiarios_icfes')) AS t(id, tipo_solicitud_id, name)""",
    "tipos_solicitudes": """
        SELECT * FROM (VALUES (1, 'Idea'), (2, 'Fase 0'), (3, 'Fase 1'), (4, 'Fase 2'),
          (5, 'Fase 3'), (6, 'Fase 4'), (7, 'Fase 5')) AS t(id, nombre)""",
    "ord": """
        SELECT o_orderkey AS k, o_custkey + 1 AS m1, o_custkey + 2 AS m2,
          o_orderkey % 10 IN (0, 1) AS idea, o_orderdate AS d, o_orderpriority AS pri
        FROM orders""",
    "valores_campos": """
        SELECT k + 1 AS solicitud_id, 101 AS campo_id, 'Idea ' || k AS valor FROM ord WHERE idea
        UNION ALL SELECT k + 1, 201, CASE WHEN k % 3 = 0 THEN '' ELSE 'Titulo ' || k END FROM ord WHERE NOT idea
        UNION ALL SELECT k + 1, 202, year(d) || CASE WHEN month(d) <= 6 THEN '-1' ELSE '-2' END
          FROM ord WHERE NOT idea AND k % 50 <> 2
        UNION ALL SELECT k + 1, 203, 'C-' || k FROM ord WHERE NOT idea AND k % 7 <> 0
        UNION ALL SELECT k + 1, 204, CASE WHEN k % 41 = 0 THEN 'abc' ELSE CAST(k % 3 + 1 AS VARCHAR) END
          FROM ord WHERE NOT idea
        UNION ALL SELECT k + 1, 204, '2' FROM ord WHERE NOT idea AND k % 29 = 0
        UNION ALL SELECT k + 1, 205, CAST(k % 25 + 1 AS VARCHAR) FROM ord WHERE NOT idea AND k % 13 <> 0
        UNION ALL SELECT k + 1, 206, CAST(m1 AS VARCHAR) FROM ord WHERE NOT idea
        UNION ALL SELECT k + 1, 207, CASE WHEN k % 17 = 0 THEN '999999999' ELSE CAST(m2 AS VARCHAR) END
          FROM ord WHERE NOT idea AND k % 2 = 0
        UNION ALL SELECT k + 1, 208, 'obj' FROM ord WHERE NOT idea
        UNION ALL SELECT k + 1, 209, 'obs ' || pri FROM ord WHERE NOT idea
        UNION ALL SELECT k + 1, 301, CAST(k - k % 10 + 1 AS VARCHAR) FROM ord WHERE NOT idea
        UNION ALL SELECT k + 1, 302, CAST(k % 40 + 1 AS VARCHAR) FROM ord WHERE NOT idea
        UNION ALL SELECT k + 1, 303, CAST(k % 30 + 1 AS VARCHAR) FROM ord WHERE NOT idea AND k % 11 <> 0
        UNION ALL SELECT k + 1, 304, CAST(k % 20 + 1 AS VARCHAR) FROM ord WHERE NOT idea AND k % 5 = 0
        UNION ALL SELECT k + 1, 305, CASE WHEN k % 40 = 23 THEN '2999-1' ELSE '2001-1' END
          FROM ord WHERE NOT idea AND k % 40 IN (5, 12, 23)
        UNION ALL SELECT k + 1, 601, CASE k % 4 WHEN 0 THEN '["' || m1 || '","' || m2 || '"]'
          WHEN 1 THEN '["' || m1 || '"]' ELSE '[' || m1 || ']' END
          FROM ord WHERE NOT idea AND k % 4 <> 3""",
    "users": """
        SELECT c_custkey + 1 AS id, c_name AS name, 'D' || c_custkey AS nro_documento,
          '3' || c_custkey AS nro_celular, c_name || '@x.edu' AS email FROM customer""",
    "niveles": "SELECT r_regionkey + 1 AS id, r_name AS nombre FROM region",
    "modalidades": "SELECT n_nationkey + 1 AS id, n_name AS nombre FROM nation",
    "actas": """
        SELECT (l_orderkey * 8 + l_linenumber) * 16777216 + CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
          l_orderkey + 1 AS proyecto_id,
          CASE l_returnflag WHEN 'A' THEN 'Aprobación de la propuesta'
            WHEN 'N' THEN 'Aprobación del informe final'
            WHEN 'R' THEN 'Aplazamiento de la propuesta' END AS descripcion,
          'A-' || l_partkey AS numero, CAST(l_shipdate AS DATE) AS fecha,
          CASE WHEN l_linenumber = 7 THEN l_shipdate END AS deleted_at
        FROM lineitem""",
    # long rows with their attribute, and the first value of each scoped attribute
    "eav": """
        SELECT v.solicitud_id, v.campo_id, v.valor, c.name, c.tipo_solicitud_id AS fase
        FROM valores_campos v JOIN campos c ON c.id = v.campo_id""",
    "picked": """
        SELECT solicitud_id, name, fase, valor FROM (
          SELECT *, row_number() OVER (PARTITION BY solicitud_id, name, fase
            ORDER BY campo_id, valor NULLS FIRST) AS rn FROM eav) WHERE rn = 1""",
    "refs": """
        SELECT solicitud_id, name, fase, ref FROM (
          SELECT *, row_number() OVER (PARTITION BY solicitud_id, name, fase
            ORDER BY campo_id, ref NULLS FIRST) AS rn
          FROM (SELECT *, CASE WHEN valor IS NULL THEN NULL ELSE
            coalesce(try_cast(nullif(regexp_extract(valor, '^[ \\t]*[+]?([0-9]+)', 1), '') AS BIGINT), 0)
            END AS ref FROM eav)) WHERE rn = 1""",
    "ref_nivel": "SELECT solicitud_id, ref FROM refs WHERE name = 'nivel' AND fase = 2",
    "ref_modalidad": "SELECT solicitud_id, ref FROM refs WHERE name = 'modalidad' AND fase = 2",
    "ref_director": "SELECT solicitud_id, ref FROM refs WHERE name = 'director_id' AND fase = 3",
    "ref_evaluador": "SELECT solicitud_id, ref FROM refs WHERE name = 'evaluador_id' AND fase = 3",
    "ref_codirector": "SELECT solicitud_id, ref FROM refs WHERE name = 'codirector_id' AND fase = 3",
    "ref_int1": "SELECT solicitud_id, ref FROM refs WHERE name = 'id_integrante_1' AND fase = 2",
    "ref_int2": "SELECT solicitud_id, ref FROM refs WHERE name = 'id_integrante_2' AND fase = 2",
    "ref_idea": "SELECT solicitud_id, ref FROM refs WHERE name = 'idea_banco' AND fase = 3",
    "grupo": "SELECT solicitud_id, valor AS periodo_grupo FROM picked WHERE name = 'periodo' AND fase = 2",
    "ancho": """
        SELECT solicitud_id, max(valor) FILTER (name = 'periodo') AS periodo,
          max(valor) FILTER (name = 'codigo_modalidad') AS consecutivo,
          max(valor) FILTER (name = 'objetivo') AS objetivo,
          max(valor) FILTER (name = 'descripcion') AS observaciones,
          max(valor) FILTER (name = 'beneficiarios_icfes') AS lista,
          max(valor) FILTER (name = 'titulo') AS titulo, count(*) AS n_valores
        FROM eav GROUP BY solicitud_id""",
    "ideas": """
        SELECT s.id, max(e.valor) FILTER (e.name = 'titulo') AS titulo_idea
        FROM solicitudes s JOIN eav e ON e.solicitud_id = s.id AND e.fase = 1
        WHERE s.tipo_solicitud_id = 1 AND s.deleted_at IS NULL GROUP BY s.id""",
    "formales": "SELECT * FROM solicitudes WHERE tipo_solicitud_id = 2 AND deleted_at IS NULL",
    "fase2": """
        SELECT solicitud_id, max(CASE WHEN name = 'periodo' THEN valor END) AS periodo
        FROM eav WHERE fase = 2 GROUP BY solicitud_id""",
    "hitos": """
        SELECT a.*, row_number() OVER (PARTITION BY proyecto_id, descripcion ORDER BY id) AS rn
        FROM actas a WHERE deleted_at IS NULL""",
    "personas": """
        SELECT s.id, ud.name AS director, ue.name AS evaluador, uc.name AS codirector,
          u1.name AS nombre_est_1, u1.nro_documento AS documento_est_1,
          u1.nro_celular AS celular_est_1, u1.email AS correo_est_1,
          u2.name AS nombre_est_2, u2.nro_documento AS documento_est_2,
          u2.nro_celular AS celular_est_2, u2.email AS correo_est_2,
          CASE WHEN u2.id IS NOT NULL THEN 2 ELSE 1 END AS participantes
        FROM solicitudes s
        LEFT JOIN ref_director rd ON rd.solicitud_id = s.id LEFT JOIN users ud ON ud.id = rd.ref
        LEFT JOIN ref_evaluador re ON re.solicitud_id = s.id LEFT JOIN users ue ON ue.id = re.ref
        LEFT JOIN ref_codirector rc ON rc.solicitud_id = s.id LEFT JOIN users uc ON uc.id = rc.ref
        LEFT JOIN ref_int1 r1 ON r1.solicitud_id = s.id LEFT JOIN users u1 ON u1.id = r1.ref
        LEFT JOIN ref_int2 r2 ON r2.solicitud_id = s.id LEFT JOIN users u2 ON u2.id = r2.ref""",
    "fechas": """
        SELECT s.id, a.numero AS acta_aprobacion_propuesta, a.fecha AS fecha_aprobacion_acta,
          f.numero AS acta_aprobacion_final, f.fecha AS fecha_aprobacion_final,
          p.numero AS acta_fecha_prorroga, p.fecha AS fecha_prorroga, a.fecha + 90 AS fecha_minima,
          CASE WHEN p.fecha IS NOT NULL THEN a.fecha + 360 ELSE a.fecha + 180 END AS fecha_maxima
        FROM formales s
        LEFT JOIN hitos a ON a.proyecto_id = s.id AND a.rn = 1 AND a.descripcion = 'Aprobación de la propuesta'
        LEFT JOIN hitos f ON f.proyecto_id = s.id AND f.rn = 1 AND f.descripcion = 'Aprobación del informe final'
        LEFT JOIN hitos p ON p.proyecto_id = s.id AND p.rn = 1 AND p.descripcion = 'Aplazamiento de la propuesta'""",
    "general": """
        SELECT s.id, w.periodo, w.consecutivo, w.objetivo, w.observaciones,
          CAST(coalesce(CASE WHEN json_valid(w.lista) THEN json_array_length(w.lista) END, 0) AS INTEGER)
            AS beneficiarios_icfes,
          coalesce(nullif(w.titulo, ''), i.titulo_idea) AS titulo,
          n.nombre AS nivel, m.nombre AS modalidad, g.* EXCLUDE (id), f.* EXCLUDE (id),
          CAST(NULL AS VARCHAR) AS link_repo, CAST(NULL AS VARCHAR) AS link_repo_exento,
          CAST(NULL AS VARCHAR) AS documento_est_1_alt, CAST(NULL AS VARCHAR) AS documento_est_2_alt,
          s.estado AS filtro_estado, s.created_at AS filtro_fecha
        FROM formales s
        LEFT JOIN ancho w ON w.solicitud_id = s.id
        LEFT JOIN ref_idea ri ON ri.solicitud_id = s.id LEFT JOIN ideas i ON i.id = ri.ref
        LEFT JOIN ref_nivel rn ON rn.solicitud_id = s.id LEFT JOIN niveles n ON n.id = rn.ref
        LEFT JOIN ref_modalidad rm ON rm.solicitud_id = s.id LEFT JOIN modalidades m ON m.id = rm.ref
        JOIN personas g ON g.id = s.id JOIN fechas f ON f.id = s.id""",
    "exportado": """
        SELECT periodo, nivel, consecutivo, titulo, modalidad, observaciones, director, evaluador,
          beneficiarios_icfes, nombre_est_1, documento_est_1, celular_est_1, correo_est_1, nombre_est_2,
          documento_est_2, celular_est_2, correo_est_2, participantes, acta_aprobacion_propuesta,
          fecha_aprobacion_acta, fecha_maxima, acta_aprobacion_final, fecha_aprobacion_final,
          acta_fecha_prorroga, fecha_prorroga, link_repo, fecha_minima FROM general""",
    "integrantes": """
        SELECT e.solicitud_id, e.name AS campo, u.id AS usuario_id, u.name, u.nro_documento
        FROM eav e JOIN users u ON u.id = coalesce(try_cast(nullif(
          regexp_extract(e.valor, '^[ \\t]*[+]?([0-9]+)', 1), '') AS BIGINT), 0)
        WHERE e.fase = 2 AND e.name IN ('id_integrante_1', 'id_integrante_2')""",
    "en_lista": """
        SELECT DISTINCT i.solicitud_id, i.usuario_id, i.name, i.nro_documento
        FROM integrantes i JOIN eav b ON b.solicitud_id = i.solicitud_id AND b.name = 'beneficiarios_icfes'
          AND CASE WHEN json_valid(b.valor) THEN json_contains(b.valor, '"' || i.usuario_id || '"') ELSE false END""",
    "base": """
        SELECT s.id, s.estado, f.solicitud_id IS NOT NULL AS con_valores, f.periodo,
          n.id AS nivel_id, m.nombre AS modalidad, g.participantes
        FROM formales s
        LEFT JOIN fase2 f ON f.solicitud_id = s.id
        LEFT JOIN ref_nivel rn ON rn.solicitud_id = s.id LEFT JOIN niveles n ON n.id = rn.ref
        LEFT JOIN ref_modalidad rm ON rm.solicitud_id = s.id LEFT JOIN modalidades m ON m.id = rm.ref
        JOIN personas g ON g.id = s.id""",
    "semestre": """
        SELECT periodo, count(*) AS proyectos_recibidos,
          count(*) FILTER (estado NOT IN ('Rechazada', 'Finalizado')) AS proyectos_vigentes,
          count(*) FILTER (estado NOT IN ('Rechazada', 'Finalizado') AND nivel_id = 1) AS vigentes_tecnologico,
          count(*) FILTER (estado NOT IN ('Rechazada', 'Finalizado') AND nivel_id = 2) AS vigentes_profesional,
          CAST(coalesce(sum(participantes) FILTER (estado NOT IN ('Rechazada', 'Finalizado')), 0) AS BIGINT)
            AS estudiantes_vigentes
        FROM base WHERE con_valores GROUP BY periodo""",
    "aprobacion": """
        SELECT periodo, count(*) AS recibidos, CAST(sum(participantes) AS BIGINT) AS recibidos_estudiantes,
          count(*) FILTER (estado IN ('Fase 4', 'Fase 5', 'Finalizado')) AS aprobados,
          CAST(coalesce(sum(participantes) FILTER (estado IN ('Fase 4', 'Fase 5', 'Finalizado')), 0) AS BIGINT)
            AS aprobados_estudiantes,
          count(*) FILTER (estado NOT IN ('Fase 4', 'Fase 5', 'Finalizado', 'Rechazada')) AS pendientes,
          CAST(coalesce(sum(participantes) FILTER
            (estado NOT IN ('Fase 4', 'Fase 5', 'Finalizado', 'Rechazada')), 0) AS BIGINT) AS pendientes_estudiantes
        FROM base WHERE con_valores GROUP BY periodo""",
    "por_modalidad": """
        SELECT modalidad, count(*) FILTER (nivel_id = 1) AS proyectos_tecnologico,
          CAST(coalesce(sum(participantes) FILTER (nivel_id = 1), 0) AS BIGINT) AS estudiantes_tecnologico,
          count(*) FILTER (nivel_id = 2) AS proyectos_profesional,
          CAST(coalesce(sum(participantes) FILTER (nivel_id = 2), 0) AS BIGINT) AS estudiantes_profesional
        FROM base GROUP BY modalidad""",
    "carga": """
        SELECT r.rol, u.name AS nombre, g.periodo_grupo, max(w.periodo) AS periodo,
          CAST(sum(w.n_valores) AS BIGINT) AS total_periodo, count(*) AS n_proyectos
        FROM formales s JOIN ancho w ON w.solicitud_id = s.id
        JOIN (SELECT 'director' AS rol, * FROM ref_director UNION ALL SELECT 'evaluador', * FROM ref_evaluador) r
          ON r.solicitud_id = s.id
        JOIN users u ON u.id = r.ref LEFT JOIN grupo g ON g.solicitud_id = s.id
        GROUP BY r.rol, u.name, g.periodo_grupo""",
    "visible": """
        SELECT rol, nombre, periodo, total_periodo AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY rol, nombre, periodo
            ORDER BY periodo_grupo DESC NULLS LAST) AS rn FROM carga) WHERE rn = 1""",
    "periodos": """
        SELECT periodo, row_number() OVER (ORDER BY periodo) - 1 AS lugar FROM (
          SELECT DISTINCT valor AS periodo FROM eav WHERE name = 'periodo' AND fase = 2 AND valor IS NOT NULL)""",
    "listadas": "SELECT v.rol, v.nombre, v.periodo, v.n, p.lugar FROM visible v JOIN periodos p ON p.periodo = v.periodo",
    "totales": """
        SELECT c.rol, c.nombre, CAST(coalesce(sum(l.n), 0) AS BIGINT) AS n
        FROM (SELECT DISTINCT rol, nombre FROM carga) c
        LEFT JOIN listadas l ON l.rol = c.rol AND l.nombre IS NOT DISTINCT FROM c.nombre GROUP BY c.rol, c.nombre""",
    "puestos": "SELECT rol, nombre, row_number() OVER (PARTITION BY rol ORDER BY nombre NULLS FIRST) AS fila FROM totales",
    "celdas": """
        SELECT rol, nombre, 0 AS es_total, periodo, n FROM listadas
        UNION ALL SELECT rol, nombre, 1, 'Total general', n FROM totales""",
    "bloques": f"""
        SELECT rol, nombre, lugar // {WIDTH} + 1 AS bloque, lugar % {WIDTH} + 1 AS lugar, n FROM listadas
        UNION ALL SELECT rol, nombre, 1, 0, n FROM totales""",
    "matriz": "SELECT rol, nombre, CAST(bloque AS INTEGER) AS bloque, "
    + ", ".join(f"max(n) FILTER (lugar = {i}) AS {p}" for i, p in enumerate(PLACES, 1))
    + ", max(n) FILTER (lugar = 0) AS total_general FROM bloques GROUP BY rol, nombre, bloque",
    "dinamica": """
        SELECT periodo, modalidad, count(*) AS cantidad,
          count(*) FILTER (estado IN ('Fase 4', 'Fase 5', 'Finalizado')) AS aprobados
        FROM base WHERE con_valores GROUP BY periodo, modalidad""",
}


CTES |= {
    "vista_por_semestre": """
        SELECT *, row_number() OVER (ORDER BY es_total, periodo NULLS FIRST) AS fila FROM (
          SELECT periodo, proyectos_recibidos, proyectos_vigentes || ' (' || vigentes_tecnologico || ' Tecnología y '
            || vigentes_profesional || ' Ingeniería)' AS proyectos_vigentes, estudiantes_vigentes, false AS es_total FROM semestre
          UNION ALL SELECT 'TOTAL', CAST(sum(proyectos_recibidos) AS BIGINT), CAST(sum(proyectos_vigentes) AS VARCHAR),
            CAST(sum(estudiantes_vigentes) AS BIGINT), true FROM semestre)""",
    "vista_aprobacion": """
        SELECT periodo, recibidos || ' (' || recibidos_estudiantes || ' estudiantes)' AS recibidos,
          aprobados || ' (Corresponde a ' || aprobados_estudiantes || ' estudiantes)' AS aprobados,
          pendientes || ' (Corresponde a ' || pendientes_estudiantes || ' estudiantes)' AS pendientes,
          row_number() OVER (ORDER BY periodo NULLS FIRST) AS fila FROM aprobacion""",
    "vista_por_modalidad": """
        SELECT *, row_number() OVER (ORDER BY es_total, proyectos_tecnologico DESC, modalidad NULLS FIRST) AS fila FROM (
          SELECT *, false AS es_total FROM por_modalidad
          UNION ALL SELECT 'Total', CAST(sum(proyectos_tecnologico) AS BIGINT),
            CAST(sum(estudiantes_tecnologico) AS BIGINT), CAST(sum(proyectos_profesional) AS BIGINT),
            CAST(sum(estudiantes_profesional) AS BIGINT), true FROM por_modalidad)""",
}


def query(text: str) -> str:
    """``text`` with the CTEs it needs, in dependency order, each computed once."""
    needed = _needed(text, set())
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name].strip()})" for name in CTES if name in needed)
    return f"WITH {ctes}\n{text.strip()}" if ctes else text.strip()


def _needed(text: str, seen: set[str]) -> set[str]:
    for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
        if name in CTES and name not in seen:
            seen.add(name)
            _needed(CTES[name], seen)
    return seen


def _matrix(section: str) -> str:
    return f"SELECT nombre, bloque, {', '.join(PLACES)}, total_general FROM matriz WHERE rol = '{section}'"


def _matrix_total(section: str) -> str:
    sums = ", ".join(
        f"CAST(nullif(sum(n) FILTER (lugar = {i}), 0) AS BIGINT) AS {p}" for i, p in [*enumerate(PLACES, 1), (0, "total_general")]
    )
    return f"""SELECT 'Total general' AS nombre, CAST(bloque AS INTEGER) AS bloque, {sums} FROM (
        SELECT bloque, lugar, n FROM bloques WHERE rol = '{section}'
        UNION ALL SELECT lugar // {WIDTH} + 1, lugar % {WIDTH} + 1, NULL FROM periodos) GROUP BY bloque"""


def _zip() -> str:
    shown = {
        s: ", ".join(f"max(n) FILTER (rol = '{s}' AND lugar = {i}) AS {s}_{p}" for i, p in [*enumerate(PLACES, 1), (0, "total_general")])
        for s in ("director", "evaluador")
    }
    names = {s: f"max(nombre) FILTER (rol = '{s}') AS {s}" for s in shown}
    return f"""SELECT fila, CAST(bloque AS INTEGER) AS bloque, {names['director']}, {shown['director']}, {names['evaluador']}, {shown['evaluador']}
        FROM (SELECT b.*, p.fila FROM bloques b JOIN puestos p ON p.rol = b.rol AND p.nombre IS NOT DISTINCT FROM b.nombre)
        GROUP BY fila, bloque"""


def _cells(section: str) -> str:
    return f"SELECT nombre, es_total, periodo, n FROM celdas WHERE rol = '{section}'"


def _cells_total(section: str) -> str:
    return f"""SELECT 'Total general' AS nombre, 0 AS es_total, p.periodo, CAST(nullif(sum(l.n), 0) AS BIGINT) AS n
        FROM periodos p LEFT JOIN listadas l ON l.periodo = p.periodo AND l.rol = '{section}' GROUP BY p.periodo
        UNION ALL SELECT 'Total general', 1, 'Total general', CAST(nullif(sum(n), 0) AS BIGINT) FROM totales WHERE rol = '{section}'"""


def _cells_beside() -> str:
    half = """SELECT p.fila, c.es_total, c.periodo, c.nombre, c.n FROM celdas c
        JOIN puestos p ON p.rol = c.rol AND p.nombre IS NOT DISTINCT FROM c.nombre WHERE c.rol = """
    return f"""SELECT coalesce(d.fila, e.fila) AS fila, coalesce(d.es_total, e.es_total) AS es_total,
        coalesce(d.periodo, e.periodo) AS periodo, d.nombre AS director, d.n AS director_n,
        e.nombre AS evaluador, e.n AS evaluador_n
        FROM ({half}'director') d FULL JOIN ({half}'evaluador') e
          ON d.fila = e.fila AND d.es_total = e.es_total AND d.periodo = e.periodo"""


# Sections of the statistics, their titles and (key, label, header above).
STATISTICS = {
    "por_semestre": ("Resumen por semestre", [
        ("periodo", "Semestre", ""), ("proyectos_recibidos", "Proyectos recibidos", ""),
        ("proyectos_vigentes", "Proyectos Vigentes", ""),
        ("estudiantes_vigentes", "No. Estudiantes Proyectos Vigentes", ""), ("es_total", "Es total", ""),
    ]),
    "aprobacion": ("Aprobación de propuestas por semestre", [
        ("periodo", "Semestre", ""), ("recibidos", "Proyectos recibidos", ""),
        ("aprobados", "Propuestas aprobadas", ""), ("pendientes", "Propuestas pendientes por aprobar", ""),
    ]),
    "por_modalidad": ("Distribución por modalidad y programa", [
        ("modalidad", "Modalidad", ""),
        ("proyectos_tecnologico", "Cantidad Proyectos", "Tecnología en Desarrollo de Sistemas Informáticos"),
        ("estudiantes_tecnologico", "No. Estudiantes", "Tecnología en Desarrollo de Sistemas Informáticos"),
        ("proyectos_profesional", "Cantidad Proyectos", "Ingeniería de Sistemas"),
        ("estudiantes_profesional", "No. Estudiantes", "Ingeniería de Sistemas"), ("es_total", "Es total", ""),
    ]),
}


def _roundtrip() -> str:
    """Every cell of the written sections as text, with the place of its row."""
    lists = []
    for section, (title, columns) in STATISTICS.items():
        for i, (key, label, group) in enumerate(columns):
            lists.append(("Estadísticas a presentar en comité curricular", section, title, str(i), group, key, label))
    names = ("titulo", "de", "titulo_seccion", "posicion", "grupo", "clave", "etiqueta")
    parts = [
        f"SELECT 'columnas' AS seccion, CAST({place} AS BIGINT) AS fila, '{name}' AS columna, '{value}' AS valor"
        for place, row in enumerate(lists, 1) for name, value in zip(names, row)
    ]
    for section, (_, columns) in STATISTICS.items():
        for key, _, _ in columns:
            parts.append(f"SELECT '{section}', fila, '{key}', CAST({key} AS VARCHAR) FROM vista_{section}")
    return "\nUNION ALL ".join(parts)


def _widths() -> str:
    from eavista.plans.general import EXPORT

    numbers = ("beneficiarios_icfes", "participantes")
    parts = []
    for label, key in EXPORT:
        blank = f"{key} <> 0" if key in numbers else f"CAST({key} AS VARCHAR) <> ''"
        parts.append(
            f"SELECT '{key}' AS columna, CAST(least(40, 2 + greatest({len(label)}, coalesce(max("
            f"length(CAST({key} AS VARCHAR))) FILTER ({blank}), 0))) AS INTEGER) AS ancho FROM exportado"
        )
    return "\nUNION ALL ".join(parts)


GENERAL = "SELECT * EXCLUDE (filtro_estado, filtro_fecha) FROM general"

QUERIES: dict[str, str] = {
    "active_projects": "SELECT id, estado, created_at FROM formales",
    "eav_named": "SELECT solicitud_id, campo_id, name, fase, valor FROM eav",
    "eav_wide": """
        SELECT s.id, w.periodo, w.consecutivo, w.objetivo, w.observaciones,
          w.lista AS lista_beneficiarios, w.titulo AS titulo_propio
        FROM formales s LEFT JOIN ancho w ON w.solicitud_id = s.id""",
    "unsigned_cast": """
        SELECT solicitud_id, campo_id, valor, CASE WHEN valor IS NULL THEN NULL ELSE
          coalesce(try_cast(nullif(regexp_extract(valor, '^[ \\t]*[+]?([0-9]+)', 1), '') AS BIGINT), 0)
          END AS numero FROM valores_campos""",
    "json_len": """
        SELECT solicitud_id, campo_id, valor, CAST(CASE WHEN json_valid(valor) THEN
          CASE json_type(valor) WHEN 'ARRAY' THEN json_array_length(valor)
            WHEN 'OBJECT' THEN len(json_keys(valor)) ELSE 1 END ELSE 0 END AS INTEGER) AS largo
        FROM valores_campos WHERE campo_id = 601""",
    "json_shapes": """
        SELECT id, texto, CAST(CASE WHEN json_valid(texto) THEN CASE json_type(texto) WHEN 'ARRAY' THEN json_array_length(texto)
            WHEN 'OBJECT' THEN len(list_distinct(json_keys(texto))) ELSE 1 END END AS INTEGER) AS largo,
          id % 10 IN (0, 2, 5, 6) AS contiene
        FROM (SELECT id, CASE id % 10 WHEN 0 THEN '["' || id || '",["' || id || 'x"]]'
            WHEN 1 THEN '{"a":"' || id || '","b":["' || id || '"],"a":1}' WHEN 2 THEN '"' || id || '"'
            WHEN 3 THEN CAST(id AS VARCHAR) WHEN 4 THEN '["' || id || '"'
            WHEN 5 THEN ' [{"a":"' || id || '"} , "' || id || '"]' || chr(10) WHEN 6 THEN '[[["' || id || '"],{}],' || id || ']'
            WHEN 7 THEN '' WHEN 8 THEN NULL ELSE '["' || id || '"] 1' END AS texto FROM solicitudes)""",
    "ref_lookup_level": """
        SELECT s.id, r.ref AS nivel_ref, n.nombre AS nivel FROM formales s
        LEFT JOIN ref_nivel r ON r.solicitud_id = s.id LEFT JOIN niveles n ON n.id = r.ref""",
    "ref_lookup_modality": """
        SELECT s.id, r.ref AS modalidad_ref, m.nombre AS modalidad FROM formales s
        LEFT JOIN ref_modalidad r ON r.solicitud_id = s.id LEFT JOIN modalidades m ON m.id = r.ref""",
    "ref_lookup_director": """
        SELECT s.id, u.id AS director_id, u.name AS director FROM formales s
        LEFT JOIN ref_director r ON r.solicitud_id = s.id LEFT JOIN users u ON u.id = r.ref""",
    "ref_lookup_idea": """
        SELECT s.id, i.titulo_idea FROM formales s
        LEFT JOIN ref_idea r ON r.solicitud_id = s.id LEFT JOIN ideas i ON i.id = r.ref""",
    "people_roles": """
        SELECT s.id, director, evaluador, codirector, nombre_est_1 AS integrante_1,
          nombre_est_2 AS integrante_2 FROM formales s JOIN personas g ON g.id = s.id""",
    "project_period": "SELECT s.id, f.periodo FROM formales s JOIN fase2 f ON f.solicitud_id = s.id",
    "participants": "SELECT s.id, g.participantes FROM formales s JOIN personas g ON g.id = s.id",
    "title_fallback": """
        SELECT s.id, w.titulo AS titulo_propio, i.titulo_idea,
          coalesce(nullif(w.titulo, ''), i.titulo_idea) AS titulo
        FROM formales s LEFT JOIN ancho w ON w.solicitud_id = s.id
        LEFT JOIN ref_idea r ON r.solicitud_id = s.id LEFT JOIN ideas i ON i.id = r.ref""",
    "milestones": """
        SELECT proyecto_id AS solicitud_id, descripcion, id AS acta_id, numero, fecha
        FROM hitos WHERE rn = 1 AND descripcion IS NOT NULL""",
    "deadlines": "SELECT id, fecha_aprobacion_acta, fecha_prorroga, fecha_minima, fecha_maxima FROM fechas",
    "members": "SELECT solicitud_id, usuario_id, name, nro_documento FROM integrantes",
    "beneficiaries": "SELECT solicitud_id, usuario_id FROM en_lista",
    "general_report": GENERAL,
    "general_filtered": GENERAL
    + """ WHERE filtro_estado = 'Fase 4' AND filtro_fecha >= TIMESTAMP '1996-03-01'
        AND filtro_fecha <= TIMESTAMP '2000-09-30'""",
    "general_export": "SELECT * FROM exportado",
    "arl_report": """
        SELECT i.name AS apellidos_nombres, i.nro_documento, n.nombre AS programa_academico, 'PRINCIPAL' AS sede
        FROM integrantes i JOIN solicitudes s ON s.id = i.solicitud_id
          AND s.tipo_solicitud_id = 5 AND s.deleted_at IS NULL
        LEFT JOIN ref_nivel r ON r.solicitud_id = s.id LEFT JOIN niveles n ON n.id = r.ref""",
    "tyt_report": """
        SELECT n.nombre AS programa, coalesce(nullif(max(w.titulo), ''), i.titulo_idea) AS titulo,
          m.nombre || ' - ' || max(w.consecutivo) AS modalidad, b.name AS estudiante,
          b.nro_documento AS id_estudiante, g.director, g.evaluador, t.nombre AS estado,
          CAST(NULL AS VARCHAR) AS observaciones
        FROM en_lista b JOIN solicitudes s ON s.id = b.solicitud_id AND s.deleted_at IS NULL
        JOIN tipos_solicitudes t ON t.id = s.tipo_solicitud_id
        LEFT JOIN ancho w ON w.solicitud_id = s.id
        LEFT JOIN ref_nivel rn ON rn.solicitud_id = s.id LEFT JOIN niveles n ON n.id = rn.ref
        LEFT JOIN ref_modalidad rm ON rm.solicitud_id = s.id LEFT JOIN modalidades m ON m.id = rm.ref
        LEFT JOIN ref_idea ri ON ri.solicitud_id = s.id LEFT JOIN ideas i ON i.id = ri.ref
        JOIN personas g ON g.id = s.id
        GROUP BY b.usuario_id, b.name, b.nro_documento, n.nombre, m.nombre, g.director, g.evaluador,
          t.nombre, i.titulo_idea""",
    "stats_semester": "SELECT * FROM semestre",
    "stats_approval": "SELECT * FROM aprobacion",
    "stats_modality": "SELECT * FROM por_modalidad",
    "stats_semester_total": """
        SELECT periodo, proyectos_recibidos, proyectos_vigentes, estudiantes_vigentes, false AS es_total FROM semestre
        UNION ALL SELECT 'TOTAL', CAST(sum(proyectos_recibidos) AS BIGINT), CAST(sum(proyectos_vigentes) AS BIGINT),
          CAST(sum(estudiantes_vigentes) AS BIGINT), true FROM semestre""",
    "stats_modality_total": """
        SELECT *, false AS es_total FROM por_modalidad
        UNION ALL SELECT 'Total', CAST(sum(proyectos_tecnologico) AS BIGINT),
          CAST(sum(estudiantes_tecnologico) AS BIGINT), CAST(sum(proyectos_profesional) AS BIGINT),
          CAST(sum(estudiantes_profesional) AS BIGINT), true FROM por_modalidad""",
    "stats_text": """
        SELECT 'por_semestre' AS seccion, periodo, CAST(proyectos_recibidos AS VARCHAR) AS recibidos,
          proyectos_vigentes || ' (' || vigentes_tecnologico || ' Tecnología y ' || vigentes_profesional
            || ' Ingeniería)' AS principales, CAST(estudiantes_vigentes AS VARCHAR) AS otros FROM semestre
        UNION ALL SELECT 'por_semestre', 'TOTAL', CAST(sum(proyectos_recibidos) AS VARCHAR),
          CAST(sum(proyectos_vigentes) AS VARCHAR), CAST(sum(estudiantes_vigentes) AS VARCHAR) FROM semestre
        UNION ALL SELECT 'aprobacion', periodo, recibidos || ' (' || recibidos_estudiantes || ' estudiantes)',
          aprobados || ' (Corresponde a ' || aprobados_estudiantes || ' estudiantes)',
          pendientes || ' (Corresponde a ' || pendientes_estudiantes || ' estudiantes)' FROM aprobacion""",
    "period_list": """
        SELECT DISTINCT valor AS periodo FROM eav
        WHERE name = 'periodo' AND fase = 2 AND valor IS NOT NULL""",
    "directores_long": """
        SELECT nombre, periodo, periodo_grupo, total_periodo, n_proyectos FROM carga WHERE rol = 'director'""",
    "evaluadores_long": """
        SELECT nombre, periodo, periodo_grupo, total_periodo, n_proyectos FROM carga WHERE rol = 'evaluador'""",
    "directores_matrix": _matrix("director"),
    "evaluadores_matrix": _matrix("evaluador"),
    "directores_matrix_total": _matrix_total("director"),
    "evaluadores_matrix_total": _matrix_total("evaluador"),
    "profesores_zip": _zip(),
    "periodos_bloques": f"""
        SELECT periodo, CAST(lugar // {WIDTH} + 1 AS INTEGER) AS bloque, CAST(lugar % {WIDTH} + 1 AS INTEGER) AS lugar FROM periodos""",
    "directores_celdas": _cells("director"),
    "evaluadores_celdas": _cells("evaluador"),
    "directores_celdas_total": _cells_total("director"),
    "evaluadores_celdas_total": _cells_total("evaluador"),
    "lado_a_lado_celdas": _cells_beside(),
    "modalidad_dynamics": "SELECT * FROM dinamica",
    "modalidad_rollup": """
        SELECT 0 AS grupo, periodo, modalidad, modalidad AS etiqueta, cantidad, aprobados,
          nullif(aprobados, 0) AS aprobados_visible FROM dinamica
        UNION ALL SELECT 1, periodo, NULL, periodo, CAST(sum(cantidad) AS BIGINT), CAST(sum(aprobados) AS BIGINT),
          CAST(nullif(sum(aprobados), 0) AS BIGINT) FROM dinamica GROUP BY periodo
        UNION ALL SELECT 3, NULL, NULL, 'Total general', CAST(sum(cantidad) AS BIGINT),
          CAST(sum(aprobados) AS BIGINT), CAST(sum(aprobados) AS BIGINT) FROM dinamica""",
    "modalidad_nested": """
        SELECT periodo, CAST(to_json(list({'modalidad': modalidad, 'cantidad': cantidad, 'aprobados': aprobados}
          ORDER BY cantidad DESC, modalidad NULLS FIRST)) AS VARCHAR) AS filas FROM dinamica GROUP BY periodo""",
    "column_widths": _widths(),
    "sink_roundtrip": _roundtrip(),
    "labelled_moments": """
        SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
          strftime(deleted_at, '%Y-%m-%d %H:%M:%S') AS deleted_at, CAST(NULL AS VARCHAR) AS no_hay, estado FROM solicitudes""",
}


def oracle_sql() -> dict[str, str]:
    return {name: query(text) for name, text in QUERIES.items()}
