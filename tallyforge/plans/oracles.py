"""SQL for DuckDB that gives the same rows as the queries, written independently of the operators."""

from __future__ import annotations

from ..operators.recommend import AREAS, NOT_FOUND, SENTENCES
from .fixtures import duck

SQL: dict[str, str] = {}


def _ratio(name: str, pairs: str) -> str:
    """A table `name` (a, b, sim): 2 M / T over longest matching blocks of the pairs (a, b) of texts.

    Of each pair the longest common block is taken, the first in a, then in b; then the parts before and behind it
    go on as pairs of their own. Lengths of all blocks are summed.
    """
    return f"""{name}_p AS ({pairs}), {name}_b(a, b, x, y, k) AS (SELECT a, b, a, b, 0 FROM {name}_p
 UNION ALL SELECT a, b, p.x, p.y, p.k FROM (SELECT a, b, unnest([{{'x': x[1 : i], 'y': y[1 : strpos(y, x[i + 1 : i + l]) - 1], 'k': l}}, {{'x': x[i + l + 1 :], 'y': y[strpos(y, x[i + 1 : i + l]) + l :], 'k': 0}}]) AS p
  FROM (SELECT a, b, x, y, (m + 999) // 1000 AS l, (m + 999) // 1000 * 1000 - m AS i FROM
   (SELECT a, b, x, y, list_max(flatten([[CASE WHEN contains(y, x[i + 1 : i + l]) THEN l * 1000 - i ELSE 0 END for l in range(1, len(x) - i + 1)] for i in range(0, len(x))])) AS m FROM {name}_b WHERE x <> '' AND y <> '') WHERE m > 0))),
 {name} AS (SELECT a, b, 2.0D * sum(k) / (length(a) + length(b)) AS sim FROM {name}_b GROUP BY a, b)"""


_REACH = "2.0D * least(length({0}), length({1})) / (length({0}) + length({1})) >= {2}"

SQL["a2_sniff_type"] = r"""
SELECT page_id, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN lower(ext) = '.jpg' THEN 'imagen' WHEN starts_with(content, '%PDF') THEN 'pdf'
 WHEN starts_with(content, 'BM') OR starts_with(content, concat('II*', chr(0))) OR (starts_with(content, 'RIFF') AND substring(content, 9, 4) = 'WEBP') THEN 'imagen' ELSE 'desconocido' END AS tipo FROM files"""

_PARSED = r"""p AS (SELECT page_id, nombre AS raw, regexp_matches(nombre, '^(.+?)[_\-\s]+(\d{1,2})[_\-\s]+([MFmf])$') AS valid FROM files),
 q AS (SELECT page_id, raw, valid, regexp_extract(raw, '^(.+?)[_\-\s]+(\d{1,2})[_\-\s]+([MFmf])$', 1) AS n, regexp_extract(raw, '^(.+?)[_\-\s]+(\d{1,2})[_\-\s]+([MFmf])$', 2) AS e, regexp_extract(raw, '^(.+?)[_\-\s]+(\d{1,2})[_\-\s]+([MFmf])$', 3) AS s FROM p)"""
SQL["a3_parse_form_name"] = f"""WITH {_PARSED}
SELECT page_id, valid, CASE WHEN valid THEN array_to_string([upper(w[1]) || lower(w[2:]) for w in regexp_split_to_array(trim(regexp_replace(n, '[-_ ]+', ' ', 'g')), ' ')], ' ') END AS nombre,
 CASE WHEN valid THEN CAST(e AS INT) END AS edad, CASE WHEN valid THEN upper(s) END AS sexo FROM q"""
SQL["a4_split_valid"] = f"""WITH {_PARSED}
SELECT page_id, CASE WHEN valid THEN 'skip:aceptado' ELSE 'skip:rechazado' END AS destino FROM q
UNION ALL SELECT page_id, CASE WHEN (SELECT count(*) FROM q WHERE NOT valid) > 0 THEN 'batch:rechazado' ELSE 'batch:aceptado' END FROM q"""
_WORK = """w AS (SELECT page_id AS file_id, md5(content) || '_' || sexo AS cache_key FROM files UNION ALL SELECT page_id + 1000000, md5(content) || '_' || sexo FROM files WHERE page_id % 50 = 0),
 c AS (SELECT md5(content) || '_' || sexo AS cache_key, 'r' || page_id AS resultado FROM files WHERE page_id % 3 = 0)"""
SQL["a5_with_cached"] = f"WITH {_WORK} SELECT file_id, w.cache_key, resultado IS NOT NULL AS cached, resultado FROM w LEFT JOIN c ON c.cache_key = w.cache_key"
SQL["a5_distinct_work"] = f"WITH {_WORK} SELECT DISTINCT cache_key FROM w WHERE cache_key NOT IN (SELECT cache_key FROM c)"
SQL["a5_process_cached"] = """WITH b AS (SELECT page_id AS file_id, 1 AS version, content, sexo FROM files UNION ALL SELECT page_id, 2, content || '+', sexo FROM files),
 k AS (SELECT *, md5(content) || '_' || sexo AS cache_key, content[1:4] <> 'RIFF' AS ok FROM b)
SELECT file_id, version, cache_key, ok AND cache_key IN (SELECT cache_key FROM k WHERE version = 1) AS cached, CAST(CASE WHEN ok THEN length(content) END AS INT) AS n, ok, CASE WHEN NOT ok THEN 'not readable' END AS error FROM k"""
SQL["a6_cache_stats"] = "SELECT count(*) AS archivos, round(sum(strlen(content)) / 1048576.0, 2) AS total_mb FROM files"
SQL["a7_run_batch"] = f"""WITH {_PARSED} SELECT page_id, CASE WHEN valid THEN CAST(e AS INT) END AS edad, valid AS ok, CASE WHEN NOT valid THEN 'bad name: ' || raw END AS error FROM q"""
SQL["a8_load_affinity"] = """SELECT 'types' AS tabla, tipo AS x, carrera AS y, CAST(ord AS VARCHAR) AS z FROM career_types
UNION ALL SELECT 'keywords', carrera, palabra, '' FROM career_keywords UNION ALL SELECT 'rules', a, b, razon FROM pair_rules UNION ALL SELECT 'weights', '5', '4', '1'"""

_CATALOG = """cat AS (SELECT carrera_id AS ord, carrera, CASE WHEN carrera_id % 3 = 0 THEN ['universitario', 'tecnico'] WHEN carrera_id % 3 = 1 THEN ['universitario'] ELSE [] END AS nivel,
 CASE WHEN carrera_id % 2 = 0 THEN ['publica'] ELSE ['publica', 'privada'] END AS institucion,
 CASE WHEN carrera_id % 11 = 0 THEN 0.0D ELSE r END AS r, CASE WHEN carrera_id % 11 = 0 THEN 0.0D ELSE i END AS i, CASE WHEN carrera_id % 11 = 0 THEN 0.0D ELSE a END AS a,
 CASE WHEN carrera_id % 11 = 0 THEN 0.0D ELSE s END AS s, CASE WHEN carrera_id % 11 = 0 THEN 0.0D ELSE e END AS e, CASE WHEN carrera_id % 11 = 0 THEN 0.0D ELSE c END AS c,
 [split_part(carrera, ' ', 1), split_part(carrera, ' ', 2), 'k' || (carrera_id % 5)] AS keywords, CASE WHEN carrera_id % 4 = 0 THEN ['al' || carrera_id] ELSE [] END AS alias FROM profiles)"""
_UNIT = "unit AS (SELECT *, sqrt(r*r + i*i + a*a + s*s + e*e + c*c) AS nrm FROM {0})"
SQL["a9_load_catalog"] = f"""WITH {_CATALOG} SELECT ord, carrera, array_to_string(nivel, ',') AS nivel, array_to_string(institucion, ',') AS institucion,
 round(r, 6) AS r, round(i, 6) AS i, round(a, 6) AS a, round(s, 6) AS s, round(e, 6) AS e, round(c, 6) AS c, array_to_string(keywords, ',') AS keywords, array_to_string(alias, ',') AS alias FROM cat"""
SQL["a10_with_batch_fields"] = "SELECT form_id, 'Colegio' AS ie, '5' AS grado, 'COMPLETA' AS nivel, strftime(DATE '2026-01-01' + CAST(form_id % 300 AS INT), '%d/%m/%Y') AS fecha FROM forms"

# Affinity of pairs, used by many.
_AFF = """rules2 AS (SELECT a, b, razon FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ord DESC, razon DESC) AS k FROM (SELECT a, b, razon, ord FROM pair_rules UNION ALL SELECT b, a, razon, ord FROM pair_rules)) WHERE k = 1),
 g2 AS (SELECT carrera, list_sort(list_distinct(list(grupo))) AS gs FROM career_groups GROUP BY carrera), k2 AS (SELECT carrera, list_sort(list_distinct(list(palabra))) AS ks FROM career_keywords GROUP BY carrera),
 rel2 AS (SELECT DISTINCT tipo, rel FROM related_types)"""
_SCORE = """SELECT p.*, CAST(CASE WHEN r.razon IS NOT NULL THEN 10 ELSE 0 END + 3 * len(list_intersect(ga.gs, gb.gs)) + len(list_intersect(ka.ks, kb.ks)) + CASE WHEN rl.rel IS NOT NULL THEN 2 ELSE 0 END AS INT) AS puntaje,
 coalesce(r.razon, list_sort(list_intersect(ga.gs, gb.gs))[1], CASE WHEN len(list_intersect(ka.ks, kb.ks)) > 0 THEN 'Área ' || array_to_string(list_sort(list_intersect(ka.ks, kb.ks))[1:2], ', ') END, 'General') AS relacion
 FROM {0} p LEFT JOIN rules2 r ON r.a = p.a AND r.b = p.b LEFT JOIN g2 ga ON ga.carrera = p.a LEFT JOIN g2 gb ON gb.carrera = p.b LEFT JOIN k2 ka ON ka.carrera = p.a LEFT JOIN k2 kb ON kb.carrera = p.b LEFT JOIN rel2 rl ON rl.tipo = p.tipo_a AND rl.rel = p.tipo_b"""
_TP = "tp AS (SELECT x.tipo AS tipo_a, y.tipo AS tipo_b, x.carrera AS a, y.carrera AS b, x.ord AS ord_a, y.ord AS ord_b FROM career_types x, career_types y WHERE x.tipo <> y.tipo AND x.carrera <> y.carrera)"
_PAIRS = f"{_AFF}, {_TP}, sp AS ({_SCORE.format('tp')})"
_BEST = f"""{_PAIRS}, rk AS (SELECT *, row_number() OVER (PARTITION BY tipo_a, tipo_b ORDER BY puntaje DESC, ord_a, ord_b) AS k FROM sp),
 b1 AS (SELECT * FROM rk WHERE k = 1),
 b2 AS (SELECT * FROM (SELECT rk.*, row_number() OVER (PARTITION BY rk.tipo_a, rk.tipo_b ORDER BY rk.k) AS k2 FROM rk JOIN b1 USING (tipo_a, tipo_b) WHERE rk.a NOT IN (b1.a, b1.b) AND rk.b NOT IN (b1.a, b1.b)) WHERE k2 = 1),
 best AS (SELECT tipo_a, tipo_b, 1 AS rango, a, b, puntaje, relacion FROM b1 UNION ALL SELECT tipo_a, tipo_b, 2, a, b, puntaje, relacion FROM b2)"""
_SUG = f"""{_BEST}, sug AS (SELECT t.form_id, best.a AS carrera, t.tipo1 AS tipo, rango = 1 AS es_principal, puntaje, relacion FROM tops t JOIN best ON best.tipo_a = t.tipo1 AND best.tipo_b = t.tipo2
 UNION ALL SELECT t.form_id, best.b, t.tipo2, rango = 1, puntaje, relacion FROM tops t JOIN best ON best.tipo_a = t.tipo1 AND best.tipo_b = t.tipo2)"""
SQL["a11_write_evaluation"] = f"""WITH {_SUG} SELECT 'formulario' AS tabla, form_id, nombre || '|' || sexo AS fila FROM forms UNION ALL SELECT 'marca', form_id, concat_ws('|', item, opcion, CASE WHEN opcion IN ('si', 'ambos') THEN 1 ELSE 0 END) FROM marks_state
 UNION ALL SELECT 'resultado', form_id, concat_ws('|', tipo, pd, coalesce(CAST(baremo AS VARCHAR), '-'), posicion) FROM ranked UNION ALL SELECT 'carrera_sugerida', form_id, concat_ws('|', carrera, tipo, es_principal) FROM sug"""
SQL["a11_write_evaluation_deleted"] = f"""WITH x AS ({SQL["a11_write_evaluation"]}) SELECT * FROM x WHERE form_id % 7 <> 0 UNION ALL SELECT tabla, -form_id - 1, fila FROM x WHERE form_id % 7 <> 0"""
SQL["a12_check_evaluation"] = """WITH bm AS (SELECT form_id, CASE WHEN num % 40 <> 0 THEN item END AS item FROM marks_state UNION ALL SELECT form_id - CASE WHEN form_id % 2 = 0 THEN 0 ELSE 1000000 END, item FROM marks_state WHERE num = 3 AND form_id % 5 = 0),
 rs AS (SELECT form_id, tipo FROM ranked UNION ALL SELECT form_id, tipo FROM ranked WHERE posicion = 1 AND form_id % 4 = 0)
SELECT 'sexo' AS problema, count(*) AS n FROM forms WHERE form_id % 9 = 0
UNION ALL SELECT 'nombre largo', count(*) FROM forms WHERE length(nombre) > 200
UNION ALL SELECT 'item nulo', count(*) FROM bm WHERE item IS NULL
UNION ALL SELECT 'marca repetida', count(*) FROM (SELECT 1 FROM bm WHERE item IS NOT NULL GROUP BY form_id, item HAVING count(*) > 1)
UNION ALL SELECT 'resultado repetido', count(*) FROM (SELECT 1 FROM rs GROUP BY form_id, tipo HAVING count(*) > 1)
UNION ALL SELECT 'marca sin formulario', count(*) FROM bm WHERE form_id NOT IN (SELECT form_id FROM forms)
UNION ALL SELECT 'resultado sin formulario', count(*) FROM rs WHERE form_id NOT IN (SELECT form_id FROM forms)"""
SQL["a13_latest"] = "SELECT o_orderkey AS form_id, o_orderdate AS fecha_procesado FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20"
_LEVEL = "CASE WHEN baremo IS NULL THEN 'sin_dato' WHEN baremo <= 39 THEN 'bajo' WHEN baremo >= 61 THEN 'alto' ELSE 'medio' END"
_T = [f"T{i}" for i in range(7)]
SQL["a14_consolidated"] = (
    "SELECT f.form_id, f.nombre, "
    + ", ".join(f"""(max(CASE WHEN n.tipo = '{t}' THEN n.pd END)) AS "Puntaje {t}", max(CASE WHEN n.tipo = '{t}' THEN {_LEVEL} END) AS "Nivel {t}" """ for t in _T)
    + ", "
    + ", ".join(f"""(SELECT max(p.texto) FROM proposals p WHERE p.form_id = f.form_id AND p.ord = {i}) AS "Carrera {i}" """ for i in (1, 2, 3))
    + " FROM forms f LEFT JOIN normed n ON n.form_id = f.form_id GROUP BY f.form_id, f.nombre"
)
SQL["a16_delete_forms"] = """SELECT 'formulario' AS tabla, form_id, nombre || '|' || sexo AS fila FROM forms WHERE form_id % 7 <> 0 UNION ALL SELECT 'marca', form_id, item || '|' || opcion FROM marks_state WHERE form_id % 7 <> 0
 UNION ALL SELECT 'resultado', form_id, concat_ws('|', tipo, pd, coalesce(CAST(baremo AS VARCHAR), '-')) FROM normed WHERE form_id % 7 <> 0"""
# The export is text: numbers as they are written, empty texts as missing.
SQL["a15_export"] = f"SELECT * FROM (SELECT nullif(CAST(COLUMNS(*) AS VARCHAR), '') FROM ({SQL['a14_consolidated']}))"

SQL["b1_item_dim"] = "SELECT bloque, num, bloque || num AS item FROM item_dim"
SQL["b2_complete_marks"] = "SELECT f.form_id, d.bloque || d.num AS item, coalesce(m.opcion, 'vacio') AS opcion FROM forms f CROSS JOIN item_dim d LEFT JOIN marks_state m ON m.form_id = f.form_id AND m.item = d.bloque || d.num"
SQL["b3_mark_points"] = "SELECT form_id, item, opcion, CASE WHEN lower(trim(opcion)) IN ('si', 'ambos') THEN 1 ELSE 0 END AS puntaje FROM marks_raw"
SQL["b4_binarize_marks"] = "SELECT form_id, item, CASE WHEN lower(trim(opcion)) IN ('si', 'ambos') THEN 'si' ELSE 'no' END AS opcion FROM marks_raw"
SQL["b5_audit_marks"] = """WITH a AS (SELECT form_id, count(*) AS total, count(*) FILTER (opcion = 'si') AS n_si, count(*) FILTER (opcion = 'no') AS n_no, count(*) FILTER (opcion = 'ambos') AS n_ambos, count(*) FILTER (opcion = 'vacio') AS n_vacio,
 coalesce(list_sort(list(item) FILTER (opcion = 'vacio')), []) AS v, coalesce(list_sort(list(item) FILTER (opcion = 'ambos')), []) AS d FROM marks_state GROUP BY form_id)
SELECT form_id, total, n_si, n_no, n_ambos, n_vacio, array_to_string(v, ',') AS vacios, array_to_string(d, ',') AS ambos, array_to_string(list_concat(v, d), ',') AS dudosos FROM a"""
_LABELS = """lb AS (SELECT form_id, CASE WHEN num % 5 = 0 THEN ' ' || lower(item) || ' ' WHEN num % 5 = 1 THEN num || bloque WHEN num % 5 = 2 THEN replace(item, '1', 'I') WHEN num % 7 = 3 THEN item || '9' ELSE replace(item, '1', 'l') END AS label FROM marks_state),
 rp AS (SELECT form_id, label, regexp_replace(translate(upper(regexp_replace(label, '\\s+', '', 'g')), 'IL', '11'), '^(\\d{1,2})([EPH])$', '\\2\\1') AS item FROM lb)""".replace("\\\\", "\\")
SQL["b6_repair_labels"] = f"WITH {_LABELS} SELECT form_id, label, item FROM rp"
SQL["b7_validate_labels"] = f"WITH {_LABELS} SELECT item, item IN (SELECT bloque || num FROM item_dim) AS valid, count(*) AS n FROM rp GROUP BY item"
_NAMES = """nm AS (SELECT form_id, CASE form_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Q' WHEN 2 THEN repeat('ab', 30) WHEN 3 THEN nombre WHEN 4 THEN '  María-José d''Alba ' ELSE 'Ana--Luz' END AS nombres, CASE WHEN form_id % 2 = 0 THEN 'Ñuñez Peña' ELSE 'R0jas!' END AS apellidos FROM forms)"""
_PROBLEM = "CASE WHEN trim({0}) = '' THEN 'vacio' WHEN length(trim({0})) < 2 THEN 'corto' WHEN length(trim({0})) > 50 THEN 'largo' WHEN NOT regexp_matches(trim({0}), '^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+([\\s''\\-][A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+)*$') THEN 'caracteres' END"
SQL["b8_validate_names"] = f"""WITH {_NAMES}, pr AS (SELECT *, {_PROBLEM.format('nombres')} AS nombres_problema, {_PROBLEM.format('apellidos')} AS apellidos_problema FROM nm)
SELECT *, nombres_problema IS NULL AND apellidos_problema IS NULL AS valid FROM pr"""
SQL["b9_sanitize_names"] = f"WITH {_NAMES} SELECT form_id, regexp_replace(nombres, '[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ\\s''\\-]', '', 'g') AS nombres, regexp_replace(apellidos, '[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ\\s''\\-]', '', 'g') AS apellidos FROM nm"
SQL["b10_full_name"] = f"WITH {_NAMES} SELECT form_id, concat_ws(' ', nullif(trim(nombres), ''), nullif(trim(apellidos), '')) AS nombre_completo, upper(concat_ws(' ', nullif(trim(nombres), ''), nullif(trim(apellidos), ''))[1]) AS inicial FROM nm"
_TOK = """SELECT image_id, pos, text, CAST(trunc("left" / 2.0) AS INT) AS "left", CAST(trunc(top / 2.0) AS INT) AS top, CAST(trunc(width / 2.0) AS INT) AS width, CAST(trunc(height / 2.0) AS INT) AS height, '{0}' AS modo FROM tokens WHERE try_cast(conf AS DOUBLE) >= 60 AND {1}"""
SQL["b11_find_tokens"] = _TOK.format("exacto", "upper(trim(text)) = 'THE'") + " UNION ALL " + _TOK.format("contiene", "contains(upper(trim(text)), 'EN')")
SQL["b12_token_summary"] = "SELECT image_id, coalesce(string_agg(trim(text), '' ORDER BY pos) FILTER (trim(text) <> ''), '') AS texto, coalesce(max(try_cast(conf AS DOUBLE)) FILTER (try_cast(conf AS DOUBLE) >= 0), 0.0D) AS conf FROM tokens GROUP BY image_id"
SQL["b13_doubtful_items"] = """WITH c AS (SELECT form_id, bloque || num AS item, num % 4 = 0 AS doble, form_id % 3 = 0 AND num % 10 = 0 AS revisar, CASE WHEN form_id % 3 = 1 THEN stroke_no < 0.8D ELSE false END AS low, form_id % 2 = 0 AS exito FROM signals),
 f AS (SELECT form_id, bool_or(revisar) AS any_r, bool_or(low) AS any_l FROM c GROUP BY form_id)
SELECT c.form_id, item FROM c JOIN f USING (form_id) WHERE CASE WHEN any_r THEN revisar WHEN any_l THEN low ELSE exito AND doble END"""
SQL["b14_form_summary"] = "SELECT form_id, CAST(sum(CASE WHEN opcion IN ('si', 'ambos') THEN 1 ELSE 0 END) AS BIGINT) AS n_si, round_even(100.0D * sum(CASE WHEN opcion IN ('si', 'ambos') THEN 1 ELSE 0 END) / count(*), 1) AS pct_si FROM marks_state GROUP BY form_id"
SQL["b14_score_view"] = "SELECT form_id, tipo, pd, baremo, CAST(row_number() OVER (PARTITION BY form_id ORDER BY baremo DESC NULLS LAST, tipo_ord) AS INT) AS lugar FROM normed"

_SIZED = "z AS (SELECT *, max(y) OVER (PARTITION BY cell_id) + 1 AS h, max(x) OVER (PARTITION BY cell_id) + 1 AS w FROM pixels)"
_INSIDE = _SIZED + """, zp AS (SELECT *, greatest(1, CAST(floor(h * {0}) AS INT)) AS py, greatest(1, CAST(floor(w * {0}) AS INT)) AS pw FROM z),
 i AS (SELECT cell_id, h >= {1} AND w >= {2} AND y >= py AND y < h - py AND x >= pw AND x < w - pw AS ins, y - py AS iy, x - pw AS ix, h - 2 * py AS ih, w - 2 * pw AS iw, CAST(ink AS DOUBLE) AS ink, CAST(gray AS DOUBLE) AS gray FROM zp)"""
_AVG = "coalesce(avg(ink) FILTER ({0}), 0.0D)"
SQL["c1_ink_features"] = f"""WITH {_INSIDE.format('0.10D', 8, 12)} SELECT cell_id, round({_AVG.format('ins')}, 9) AS dens_total,
 round({_AVG.format('ins AND iy >= floor(ih * 0.20D) AND iy < floor(ih * 0.80D) AND ix >= floor(iw * 0.20D) AND ix < floor(iw * 0.80D)')}, 9) AS dens_centro,
 round({_AVG.format('ins AND ix < greatest(1, floor(iw / 5.0D))')}, 9) AS dens_izq, round({_AVG.format('ins AND ix >= least(iw - 1, floor(4 * iw / 5.0D))')}, 9) AS dens_der, {_AVG.format('ins')} >= 0.020D AS marcada FROM i GROUP BY cell_id"""
SQL["c2_half_density"] = f"WITH {_INSIDE.format('0.10D', 8, 12)} SELECT cell_id, round({_AVG.format('ins AND ix < floor(iw / 2.0D)')}, 9) AS dens_izq, round({_AVG.format('ins AND ix >= floor(iw / 2.0D)')}, 9) AS dens_der FROM i GROUP BY cell_id"
SQL["c3_quadrant_symmetry"] = f"""WITH {_SIZED}, p AS (SELECT cell_id, h >= 4 AND w >= 4 AS big, y >= floor(h / 2.0D) AS b, x >= floor(w / 2.0D) AS r, CASE WHEN y < 8 AND cell_id % 2 = 0 THEN 0 ELSE ink END AS ink FROM z)
SELECT cell_id, sum(CASE WHEN big AND d >= 0.01 THEN 0.25D ELSE 0.0D END) AS simetria FROM (SELECT cell_id, big, b, r, avg(ink) AS d FROM p GROUP BY ALL) GROUP BY cell_id"""
SQL["c4_gray_variance"] = f"""WITH {_INSIDE.format('0.15D', 5, 5)}, s AS (SELECT cell_id, count(*) FILTER (ins) AS n, sum(CAST(gray AS BIGINT)) FILTER (ins) AS s, sum(CAST(gray * gray AS BIGINT)) FILTER (ins) AS q FROM i GROUP BY cell_id)
SELECT cell_id, least(1.0D, coalesce(CAST(n * q - s * s AS DOUBLE) / nullif(CAST(n * n AS DOUBLE), 0), 0.0D) / 2000.0D) AS varianza FROM s"""
SQL["c5_border_dark_share"] = f"""WITH {_SIZED}, zb AS (SELECT *, greatest(2, floor(h * 0.03D)) AS bh, greatest(2, floor(w * 0.03D)) AS bw FROM z),
 p AS (SELECT cell_id, gray, CASE WHEN h >= 10 AND w >= 10 THEN CAST(y < bh AS INT) + CAST(y >= h - bh AS INT) + CAST(x < bw AS INT) + CAST(x >= w - bw AS INT) ELSE 0 END AS k FROM zb),
 q AS (SELECT cell_id, coalesce(sum(CASE WHEN gray < 128 THEN k ELSE 0 END) / nullif(CAST(sum(k) AS DOUBLE), 0), 0.0D) AS d FROM p GROUP BY cell_id)
SELECT cell_id, round(d, 9) AS oscuro, d > 0.02D AS foto FROM q"""
SQL["c6_quality_gate"] = """WITH s AS (SELECT form_id, bloque, num, dens_no AS a, dens_si * 4 AS b, stroke_no * 400 AS n FROM signals),
 t AS (SELECT *, CASE WHEN a < 0.005D THEN 'densidad baja' WHEN a > 0.70D THEN 'densidad alta' WHEN n < 100 THEN 'borrosa' END AS pa, b < 0.005D OR b > 0.70D OR n < 100 AS pb FROM s)
SELECT form_id, bloque, num, CASE WHEN pa IS NULL THEN 'otsu' WHEN NOT pb THEN 'adaptativo' END AS metodo, coalesce(pa, 'OK') AS motivo FROM t"""
SQL["c7_diff_gate"] = "SELECT form_id, bloque, num, CASE WHEN num % 6 <> 0 AND dens_no >= 0.001D AND dens_no <= 0.030D THEN 'diff' ELSE 'clasico' END AS modo FROM signals"
SQL["c8_profile_peaks"] = "WITH s AS (SELECT cell_id, y, sum(ink) AS t FROM pixels GROUP BY ALL), m AS (SELECT *, max(t) OVER (PARTITION BY cell_id) AS top FROM s) SELECT cell_id, y AS pos, CAST(t AS BIGINT) AS tinta FROM m WHERE t > top * 0.6D"
_ROWS = """d1 AS (SELECT page_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY page_id ORDER BY pos) > 12 THEN 1 ELSE 0 END AS nw FROM cuts),
 d2 AS (SELECT page_id, pos, sum(nw) OVER (PARTITION BY page_id ORDER BY pos RANGE UNBOUNDED PRECEDING) AS g FROM d1),
 cl AS (SELECT page_id, g, CAST(trunc(avg(pos)) AS INT) AS pos FROM d2 GROUP BY page_id, g)"""
_IV = f"""{_ROWS}, iv0 AS (SELECT page_id, pos AS y1, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS y2 FROM cl),
 iv AS (SELECT page_id, y1, y2, row_number() OVER (PARTITION BY page_id ORDER BY y1) AS fila FROM iv0 WHERE y2 > y1)"""
SQL["c9_cluster_coords"] = f"WITH {_ROWS} SELECT page_id, pos FROM cl"
SQL["c10_cuts_to_intervals"] = """WITH c AS (SELECT DISTINCT page_id, pos FROM cuts), l AS (SELECT page_id, pos AS y1, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS y2 FROM c)
SELECT page_id, y1, y2, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1) AS INT) AS fila FROM l WHERE y2 > y1"""
_PP = "pp AS (SELECT cell_id // 50 AS page_id, CAST(cell_id % 50 * 16 + y AS INT) AS y, x, ink FROM pixels)"
SQL["c11_insert_missing_cuts"] = f"""WITH {_PP}, lp AS (SELECT DISTINCT page_id, y, x FROM pp WHERE ink = 1), ct AS (SELECT page_id, CAST(98 * part + unnest([0, 8, 16, 24, 48, 56, 90]) AS INT) AS pos FROM (SELECT DISTINCT page_id, y // 98 AS part FROM pp)),
 gp AS (SELECT page_id, pos AS y1, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS y2 FROM ct),
 wd AS (SELECT * FROM (SELECT *, y2 - y1 AS size, median(y2 - y1) OVER (PARTITION BY page_id) AS med FROM gp WHERE y2 IS NOT NULL) WHERE size > 10 AND size > med * 1.6D),
 rw AS (SELECT page_id, y, count(*) AS t FROM lp GROUP BY ALL),
 zn AS (SELECT wd.page_id, y1, size, y, t, max(t) OVER (PARTITION BY wd.page_id, y1) AS top FROM wd JOIN rw ON rw.page_id = wd.page_id AND y >= y1 AND y < y2),
 md AS (SELECT *, row_number() OVER (PARTITION BY page_id, y1 ORDER BY t DESC, y) AS k FROM zn WHERE y - y1 >= size // 3 AND y - y1 < 2 * size // 3),
 ok AS (SELECT md.page_id, md.y AS pos FROM md JOIN lp ON lp.page_id = md.page_id AND abs(lp.y - md.y) <= 1 WHERE k = 1 AND t > top * 0.20D GROUP BY md.page_id, md.y HAVING count(DISTINCT x) / 24.0D >= 0.35D)
SELECT page_id, pos FROM ct UNION SELECT page_id, pos FROM ok"""
SQL["c12_fit_rows"] = f"""WITH {_IV}, r AS (SELECT page_id, y1, y2, y2 - y1 AS alto FROM iv),
 m AS (SELECT *, count(*) OVER w AS n, median(alto) OVER w AS med, row_number() OVER (PARTITION BY page_id ORDER BY y1) AS ix FROM r WINDOW w AS (PARTITION BY page_id)),
 c AS (SELECT *, alto >= 0.5 * med AND alto <= 1.8 * med AS f1, alto >= 0.3 * med AND alto <= 2.5 * med AS f2 FROM m),
 d AS (SELECT *, sum(CAST(f1 AS INT)) OVER w AS n1, sum(CAST(f2 AS INT)) OVER w AS n2 FROM c WINDOW w AS (PARTITION BY page_id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN n1 >= 40 THEN f1 WHEN n2 >= 40 THEN f2 ELSE true END DESC, CASE WHEN n1 >= 40 OR n2 >= 40 THEN abs(alto - med) ELSE 0 END, y1) AS near FROM d)
SELECT page_id, y1, y2, CASE WHEN n = 40 THEN 'exacta' WHEN n > 40 AND n <= 48 THEN 'ultimas' ELSE 'altura' END AS caso FROM k WHERE n >= 40 AND CASE WHEN n = 40 THEN true WHEN n <= 48 THEN ix > n - 40 ELSE near <= 40 END"""
SQL["c13_uniform_grid"] = """WITH p AS (SELECT s_suppkey AS page_id, CAST(s_suppkey * 37 % 2000 AS INT) AS h, greatest(30, CAST(floor(CAST(s_suppkey * 37 % 2000 AS INT) * 0.05D) AS INT)) AS m FROM supplier), q AS (SELECT *, (h - m) / 33.0D AS st, unnest(range(0, 33)) AS i FROM p WHERE h > m)
SELECT page_id, CAST(i + 1 AS INT) AS fila, CAST(floor(m + i * st) AS INT) AS y1, least(h, CAST(floor(m + (i + 1) * st) AS INT)) AS y2 FROM q"""
SQL["c14_best_cut_pair"] = """WITH w AS (SELECT DISTINCT page_id, CAST(200 + page_id * 53 % 900 AS INT) AS w FROM cuts),
 c AS (SELECT DISTINCT cuts.page_id, pos, w, CAST(pos AS DOUBLE) / w AS p FROM cuts JOIN w ON w.page_id = cuts.page_id WHERE CAST(pos AS DOUBLE) / w > 0.04D AND CAST(pos AS DOUBLE) / w < 0.96D),
 pr AS (SELECT a.page_id, a.pos AS x1, b.pos AS x2, row_number() OVER (PARTITION BY a.page_id ORDER BY abs(a.p - 0.13D) + abs(b.p - 0.56D), a.pos, b.pos) AS k FROM c a JOIN c b ON b.page_id = a.page_id
  WHERE a.p >= 0.08D AND a.p <= 0.28D AND b.p >= 0.45D AND b.p <= 0.68D AND b.pos - a.pos >= a.w * 0.10D AND a.w - b.pos >= a.w * 0.10D)
SELECT w.page_id, w.w, coalesce(x1, CAST(floor(w.w * 0.13D) AS INT)) AS corte_n, coalesce(x2, CAST(floor(w.w * 0.56D) AS INT)) AS corte_no, x1 IS NULL AS por_defecto FROM w LEFT JOIN pr ON pr.page_id = w.page_id AND k = 1"""
SQL["c15_filter_boxes"] = """WITH b AS (SELECT * FROM boxes), g AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x, y, w, h, box_id) AS tabla, count(*) OVER (PARTITION BY page_id) AS n FROM b WHERE w * h >= 40000 AND h >= 450 AND w <= 600),
 f AS (SELECT page_id, CAST(tabla AS INT) AS tabla, x, w, false AS fallback FROM g WHERE n >= 3 AND tabla <= 3)
SELECT * FROM f UNION ALL SELECT page_id, k.t, k.x, k.w, true FROM (SELECT DISTINCT page_id FROM b WHERE page_id NOT IN (SELECT page_id FROM f)) CROSS JOIN (SELECT 1 AS t, 0 AS x, 333 AS w UNION ALL SELECT 2, 333, 333 UNION ALL SELECT 3, 666, 334) k"""
SQL["c16_assign_items"] = f"""WITH {_IV}, r AS (SELECT page_id, CAST(1 + y1 % 3 AS INT) AS tabla, y1, CASE WHEN fila % 9 = 0 THEN y1 + 2 ELSE y2 END AS y2 FROM iv), n AS (SELECT *, row_number() OVER (PARTITION BY page_id, tabla ORDER BY y1) AS num FROM r)
SELECT page_id, CASE tabla WHEN 1 THEN 'E' WHEN 2 THEN 'P' ELSE 'H' END || num AS item, y1, y2 FROM n WHERE num <= CASE tabla WHEN 1 THEN 33 WHEN 2 THEN 47 ELSE 38 END AND y2 - y1 >= 3"""
SQL["c17_pixels_to_cells"] = f"""WITH {_PP} SELECT page_id, CAST(y // 10 AS INT) AS cell, count(*) AS n, CAST(sum(ink) AS BIGINT) AS tinta, CAST(max(y % 10) AS INT) AS cy, CAST(max(x - 4) AS INT) AS cx FROM pp WHERE y % 10 < 7 AND x >= 4 AND x < 19 GROUP BY page_id, y // 10"""
SQL["c18_skew_angle"] = """WITH a AS (SELECT page_id, degrees(atan2(y2 - y1, x2 - x1)) AS g, abs(x2 - x1) >= 1 AS ok FROM segments), m AS (SELECT page_id, coalesce(median(CASE WHEN g < -45 THEN g + 90 WHEN g > 45 THEN g - 90 ELSE g END) FILTER (ok), 0.0D) AS m FROM a GROUP BY page_id)
SELECT page_id, round(m, 6) AS mediana, round(CASE WHEN abs(m) < 0.3D OR abs(m) > 15 THEN 0.0D ELSE m END, 6) AS angulo FROM m"""

_BL = """bl AS (SELECT form_id, bloque, count(*) AS n, quantile_cont(greatest(dens_no, dens_si), 0.25) AS p25, quantile_cont(greatest(dens_no, dens_si), 0.5) AS p50, quantile_cont(greatest(dens_no, dens_si), 0.75) AS p75, max(greatest(dens_no, dens_si)) AS max_d, median(least(dens_no, dens_si)) AS mm FROM signals GROUP BY ALL),
 rg AS (SELECT *, CASE WHEN n < 5 OR max_d < 0.020D THEN 'vacio' WHEN p25 > 0.040D THEN 'marcado' ELSE 'mixto' END AS regimen,
  CASE WHEN n < 5 OR max_d < 0.020D THEN 0.0D WHEN p25 > 0.040D THEN greatest(0.005D, least(0.020D, p25 * 0.4D)) WHEN p75 < 0.020D THEN 0.005D ELSE greatest(0.005D, least(0.020D, (p25 + p75) / 2)) END AS umbral FROM bl)"""
SQL["d1_cell_marked"] = "SELECT form_id, bloque, num, dens_no >= 0.020D OR (stroke_no * 60 >= 0.025D * (400 + num * 60) AND stroke_no * 60 >= 20) AS marcada FROM signals"
SQL["d2_classify_simple"] = """WITH s AS (SELECT *, dens_no >= 0.02D AS a, dens_si >= 0.02D AS b FROM signals),
 o AS (SELECT *, CASE WHEN b AND NOT a THEN 'si' WHEN a AND NOT b THEN 'no' WHEN NOT a AND NOT b THEN 'vacio' WHEN dens_si > dens_no * 1.5D THEN 'si' WHEN dens_no > dens_si * 1.5D THEN 'no' WHEN abs(dens_si - dens_no) >= 0.005D THEN CASE WHEN dens_si > dens_no THEN 'si' ELSE 'no' END ELSE 'ambos' END AS opcion FROM s)
SELECT form_id, bloque, num, opcion, CASE WHEN opcion IN ('si', 'ambos') THEN 1 ELSE 0 END AS puntaje, CASE WHEN NOT (a AND b) THEN 'alta' WHEN opcion = 'ambos' THEN 'baja' ELSE 'media' END AS confianza FROM o"""
SQL["d3_block_regime"] = f"WITH {_BL} SELECT form_id, bloque, n, round(p25, 9) AS p25, round(p50, 9) AS p50, round(p75, 9) AS p75, round(max_d, 9) AS max_d, regimen, round(umbral, 9) AS umbral FROM rg"
SQL["d4_residual_blocks"] = f"WITH {_BL} SELECT form_id, bloque, round(mm, 9) AS mediana_min, mm > 0.05D AS residual FROM rg"
SQL["d5_is_real_mark"] = f"""WITH {_BL} SELECT s.form_id, s.bloque, num, CASE WHEN dens_no >= umbral THEN NOT (centro_no < umbral * 0.25D) AND NOT (stroke_no < 0.10D) ELSE (p50 > 0.001D AND dens_no > p50 * 2.5D AND (centro_no > 0.005D OR stroke_no > 0.25D)) OR (dens_no > 0.025D AND stroke_no > 0.15D) END AS "real"
FROM signals s JOIN rg ON rg.form_id = s.form_id AND rg.bloque = s.bloque"""
_VOTE = f"""{_BL}, v0 AS (SELECT s.*, rg.umbral AS u, rg.regimen, rg.mm, CASE WHEN centro_no > 0.22D THEN 0 ELSE 1 END AS kn, CASE WHEN centro_si > 0.22D THEN 0 ELSE 1 END AS ks FROM signals s JOIN rg ON rg.form_id = s.form_id AND rg.bloque = s.bloque),
 v1 AS (SELECT *, dens_no * kn AS dn, dens_si * ks AS ds, centro_no * kn AS cn, centro_si * ks AS cs, stroke_no * kn AS tn, stroke_si * ks AS ts, dt_no * kn AS xn, dt_si * ks AS xs FROM v0),
 v2 AS (SELECT *, 2 * CAST(dn >= u AS INT) + 4 * CAST(cn >= u * 0.25D AS INT) + 2 * CAST(tn >= 0.10D AND dn > u * 0.5D AS INT) + 2 * CAST(xn >= 0.25D AS INT) AS sn,
  2 * CAST(ds >= u AS INT) + 4 * CAST(cs >= u * 0.25D AS INT) + 2 * CAST(ts >= 0.10D AND ds > u * 0.5D AS INT) + 2 * CAST(xs >= 0.25D AS INT) AS ss FROM v1),
 v3 AS (SELECT *, CASE WHEN sn < 3 AND ss < 3 THEN 'vacio|alta' WHEN abs(sn - ss) >= 3 THEN CASE WHEN ss > sn THEN 'si' ELSE 'no' END || CASE WHEN abs(sn - ss) >= 5 THEN '|alta' ELSE '|media' END
  WHEN sn <> ss AND ds > dn THEN 'si|media' WHEN sn <> ss AND dn > ds THEN 'no|media' WHEN abs(cs - cn) > 0.003D THEN CASE WHEN cs > cn THEN 'si|media' ELSE 'no|media' END
  WHEN sym_si > sym_no AND sym_si >= 0.5D THEN 'si|media' WHEN sym_no > sym_si AND sym_no >= 0.5D THEN 'no|media' WHEN sn >= 5 AND ss >= 5 THEN 'ambos|baja' ELSE 'vacio|baja' END AS vv FROM v2),
 vote AS (SELECT *, split_part(vv, '|', 1) AS opcion, split_part(vv, '|', 2) AS confianza, CASE WHEN vv = 'ambos|baja' THEN 'empate de score con ambos altos' WHEN vv = 'vacio|baja' THEN 'empate de score con ambos bajos' END AS motivo FROM v3)"""
SQL["d6_classify_vote"] = f"WITH {_VOTE} SELECT form_id, bloque, num, opcion, CASE WHEN opcion IN ('si', 'ambos') THEN 1 ELSE 0 END AS puntaje, confianza, motivo IS NOT NULL AS revisar, motivo FROM vote"
_FLAGS = """mx AS (SELECT *, greatest(dens_no, dens_si) AS d, row_number() OVER w AS ix, count(*) OVER (PARTITION BY form_id, bloque) AS n, sum(dens_no) OVER (PARTITION BY form_id, bloque) AS tn, sum(dens_si) OVER (PARTITION BY form_id, bloque) AS ts FROM signals WINDOW w AS (PARTITION BY form_id, bloque ORDER BY num)),
 nb AS (SELECT x.form_id, x.bloque, x.num, median(y.d) AS med FROM mx x JOIN mx y ON y.form_id = x.form_id AND y.bloque = x.bloque AND abs(y.ix - x.ix) BETWEEN 1 AND 2 GROUP BY ALL),
 sw AS (SELECT form_id, bloque, max(d) FILTER (ix = 1) AS d0, max(d) FILTER (ix = 2) AS d1, sum(dens_no) FILTER (ix > 1) AS rn, sum(dens_si) FILTER (ix > 1) AS rs,
  max(CASE WHEN d >= 0.030D THEN CASE WHEN dens_no > dens_si THEN 'no' ELSE 'si' END END) FILTER (ix = 1) AS w0, max(CASE WHEN d >= 0.030D THEN CASE WHEN dens_no > dens_si THEN 'no' ELSE 'si' END END) FILTER (ix = 2) AS w1,
  max(CASE WHEN d >= 0.030D THEN CASE WHEN dens_no > dens_si THEN 'no' ELSE 'si' END END) FILTER (ix = 3) AS w2, count(*) AS n FROM mx GROUP BY ALL),
 sx AS (SELECT *, CASE WHEN rn > rs * 3 THEN 'no' WHEN rs > rn * 3 THEN 'si' END AS tr FROM sw),
 fl AS (SELECT mx.form_id, mx.bloque, mx.num, mx.n >= 5 AND d > 0.060D AND least(stroke_no, stroke_si) < 0.12D AS low_stroke,
  mx.n >= 5 AND coalesce(nb.med > 0.001D AND d > nb.med * 4, false) AS neighbors,
  mx.n >= 5 AND ((tn > ts * 3 AND tn > 0.5D AND dens_si > 0.060D AND dens_no < 0.005D) OR (ts > tn * 3 AND ts > 0.5D AND dens_no > 0.060D AND dens_si < 0.005D)) AS inversion,
  d >= 0.05D AND (dens_no > dens_si) <> (tn > ts) AND ix <= 2 AS incoherent,
  coalesce(sx.n >= 4 AND w0 <> tr AND w1 = tr AND w2 = tr AND d0 >= 0.030D AND d1 >= 0.030D AND greatest(d0, d1) / greatest(least(d0, d1), 0.001D) <= 3.0D AND ix <= 2, false) AS swap
  FROM mx LEFT JOIN nb ON nb.form_id = mx.form_id AND nb.bloque = mx.bloque AND nb.num = mx.num LEFT JOIN sx ON sx.form_id = mx.form_id AND sx.bloque = mx.bloque)"""
# The same flags with sums of decimals, which don't depend on the order of rows: where both columns weigh the same, doubles leave the trend to chance.
_EXACT_FLAGS = _FLAGS.replace("sum(dens_no)", "sum(CAST(dens_no AS DECIMAL(26, 12)))").replace("sum(dens_si)", "sum(CAST(dens_si AS DECIMAL(26, 12)))")
for _id, _name in (("d7", "low_stroke"), ("d8", "neighbors"), ("d9", "inversion"), ("d10", "incoherent"), ("d11", "swap")):
    SQL[f"{_id}_flag_{_name}"] = f"WITH {_FLAGS} SELECT form_id, bloque, num, {_name} FROM fl"
SQL["d10_flag_incoherent"] = f"WITH {_EXACT_FLAGS} SELECT form_id, bloque, num, incoherent FROM fl"
_REV = f"""{_VOTE}, {_EXACT_FLAGS}, rv AS (SELECT vote.form_id, vote.bloque, vote.num, vote.bloque || vote.num AS item, opcion, confianza, regimen, mm, motivo IS NOT NULL OR low_stroke OR neighbors OR inversion OR incoherent OR swap AS revisar,
  CASE WHEN swap THEN 'posible swap de filas' ELSE coalesce(motivo, CASE WHEN low_stroke OR neighbors OR inversion OR incoherent THEN 'outlier del bloque' END) END AS motivo
  FROM vote JOIN fl ON fl.form_id = vote.form_id AND fl.bloque = vote.bloque AND fl.num = vote.num)"""
SQL["d12_merge_review"] = f"WITH {_REV} SELECT form_id, item, revisar, motivo FROM rv"
SQL["d12_review_list"] = f"WITH {_REV} SELECT form_id, string_agg(item, ',' ORDER BY item) AS items_revisar FROM rv WHERE revisar GROUP BY form_id"
_CF = f"""{_REV}, cf AS (SELECT form_id, item, CASE WHEN mm > 0.05D OR regimen = 'vacio' THEN 'vacio' ELSE opcion END AS opcion, CASE WHEN mm > 0.05D OR regimen = 'vacio' THEN 'alta' ELSE confianza END AS confianza,
  CASE WHEN mm > 0.05D OR regimen = 'vacio' THEN false ELSE revisar END AS revisar, CASE WHEN mm > 0.05D THEN 'cuadrícula residual en el bloque' WHEN regimen = 'vacio' THEN NULL ELSE motivo END AS motivo FROM rv)"""
SQL["d13_classify_forms"] = f"WITH {_CF} SELECT form_id, item, opcion, CASE WHEN opcion IN ('si', 'ambos') THEN 1 ELSE 0 END AS puntaje, confianza, revisar, motivo FROM cf"
SQL["d14_form_outcome"] = f"""WITH {_CF}, o AS (SELECT form_id, count(*) AS procesados, count(*) FILTER (opcion = 'vacio') AS vacios, count(*) FILTER (opcion = 'ambos') AS ambos, count(*) FILTER (revisar) AS a_revisar FROM cf GROUP BY form_id)
SELECT *, CASE WHEN procesados >= 118 AND form_id % 4 <> 0 THEN 'ok' WHEN procesados >= 109 THEN 'warn' ELSE 'fail' END AS estado FROM o"""

SQL["e1_raw_scores"] = """WITH k AS (SELECT m.form_id, i.tipo, i.bloque FROM marks_state m JOIN item_map i ON i.item = m.item WHERE m.opcion IN ('si', 'ambos'))
SELECT f.form_id, t.tipo, count(k.tipo) FILTER (k.bloque = 'E') AS pd_e, count(k.tipo) FILTER (k.bloque = 'P') AS pd_p, count(k.tipo) FILTER (k.bloque = 'H') AS pd_h, count(k.tipo) AS pd FROM forms f CROSS JOIN types t LEFT JOIN k ON k.form_id = f.form_id AND k.tipo = t.tipo GROUP BY f.form_id, t.tipo"""
SQL["e2_norm_scores"] = "SELECT s.form_id, CASE WHEN s.form_id % 10 = 0 THEN '?' ELSE s.sexo END AS sexo, s.tipo, s.pd, n.baremo FROM scores s LEFT JOIN norms n ON n.tipo = s.tipo AND n.pd = s.pd AND n.sexo = CASE WHEN s.form_id % 10 <> 0 AND s.sexo = 'F' THEN 'F' ELSE 'M' END"
SQL["e3_level"] = f"SELECT form_id, tipo, baremo, {_LEVEL} AS nivel FROM normed"
SQL["e4_level_by_range"] = "SELECT form_id, tipo, pd, CASE WHEN tipo_ord = 6 THEN 'bajo' WHEN pd <= 5 THEN 'bajo' WHEN pd <= 9 THEN 'medio' WHEN pd <= 12 THEN 'alto' ELSE 'bajo' END AS nivel FROM scores"
SQL["e5_rank_types"] = "SELECT form_id, tipo, pd, baremo, posicion FROM ranked"
SQL["e6_top_types"] = "SELECT form_id, tipo1, tipo2 FROM tops"
SQL["e7_type_key"] = """WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Técnico ' || p_brand WHEN 1 THEN 'ARTÍSTICO ' || p_brand ELSE 'Investigativo' END AS tipo FROM part)
SELECT p_partkey, tipo, CASE WHEN tipo = 'Investigativo' THEN 'investigacion' ELSE translate(lower(tipo), ' áéíóú', '_aeiou') END AS clave FROM t"""
_LV = f"lv AS (SELECT *, {_LEVEL} AS nivel FROM normed), pt AS (SELECT form_id, max(nivel) FILTER (tipo = 'T5') AS e, max(nivel) FILTER (tipo = 'T0') AS l FROM lv GROUP BY form_id)"
_POT = "CASE {0} WHEN 'ALTO' THEN 'ALTO' WHEN 'MEDIO' THEN 'EN DESARROLLO' ELSE 'BAJO' END"
SQL["e8_potential"] = f"""WITH {_LV}, p AS (SELECT form_id, CASE e WHEN 'alto' THEN 'ALTO' WHEN 'medio' THEN 'MEDIO' ELSE 'BAJO' END AS potencial, 'enterprise' AS modo FROM pt UNION ALL SELECT form_id, CASE WHEN e = 'alto' AND l = 'alto' THEN 'ALTO' WHEN e IN ('medio', 'alto') THEN 'MEDIO' ELSE 'BAJO' END, 'both' FROM pt)
SELECT form_id, potencial, {_POT.format('potencial')} AS texto, modo FROM p"""
SQL["e9_criteria_rollup"] = """WITH c AS (SELECT form_id, 'C' || (tipo_ord % 3) AS criterio, tipo_ord % 3 AS o, CAST(sum(pd) AS BIGINT) AS pd_total, max(coalesce(baremo, 0)) AS baremo_max, string_agg(tipo, ',' ORDER BY tipo_ord) AS tipos FROM normed GROUP BY ALL)
SELECT form_id, criterio, pd_total, baremo_max, tipos, row_number() OVER (PARTITION BY form_id ORDER BY baremo_max DESC, o) = 1 AS predominante FROM c"""
SQL["e10_profile_from_items"] = """WITH a AS (SELECT 'A' || tipo_ord AS area, item FROM item_map WHERE tipo_ord < 5), n AS (SELECT area, count(*) AS n FROM a GROUP BY area), f AS (SELECT DISTINCT form_id FROM marks_state),
 k AS (SELECT form_id, area, count(*) AS k FROM marks_state m JOIN a ON a.item = m.item WHERE opcion IN ('si', 'ambos') GROUP BY ALL)
SELECT f.form_id, n.area, round(coalesce(k.k, 0) / CAST(n.n AS DOUBLE), 6) AS valor FROM f CROSS JOIN n LEFT JOIN k ON k.form_id = f.form_id AND k.area = n.area UNION ALL SELECT form_id, 'A9', 0.0D FROM f"""
SQL["e11_profile_from_norms"] = """SELECT form_id, round(least(1.0D, coalesce(avg(baremo) FILTER (tipo_ord IN (0, 5)), 0.0D) / 99.0D), 6) AS r, round(least(1.0D, coalesce(avg(baremo) FILTER (tipo_ord = 1), 0.0D) / 99.0D), 6) AS i,
 round(least(1.0D, coalesce(avg(baremo) FILTER (tipo_ord = 2), 0.0D) / 99.0D), 6) AS a, round(least(1.0D, coalesce(avg(baremo) FILTER (tipo_ord = 3), 0.0D) / 99.0D), 6) AS s, round(least(1.0D, coalesce(avg(baremo) FILTER (tipo_ord = 4), 0.0D) / 99.0D), 6) AS e, 0.0D AS c FROM normed GROUP BY form_id"""
SQL["e12_level_counts"] = f"WITH {_LV} SELECT form_id, count(*) FILTER (nivel = 'alto') AS alto, count(*) FILTER (nivel = 'medio') AS medio, count(*) FILTER (nivel = 'bajo') AS bajo, count(*) FILTER (nivel = 'sin_dato') AS sin_dato FROM lv GROUP BY form_id"
SQL["e13_relative_level"] = "WITH m AS (SELECT form_id, tipo, pd, max(pd) OVER (PARTITION BY form_id) AS top FROM scores) SELECT form_id, tipo, CASE WHEN top <= 0 THEN 'sin_dato' WHEN pd / CAST(top AS DOUBLE) * 100 >= 80 THEN 'alto' WHEN pd / CAST(top AS DOUBLE) * 100 >= 50 THEN 'medio' ELSE 'bajo' END AS relativo FROM m"
_DIFF = "SELECT form_id, tipo, round_even((baremo - rf) / CAST(rf AS DOUBLE) * 100, 1) AS diff_pct, '{0}' AS ref FROM (SELECT *, row_number() OVER w AS ix, first(baremo) OVER w AS rf FROM normed WINDOW w AS (PARTITION BY form_id ORDER BY {1})) WHERE ix > 1 AND baremo IS NOT NULL AND rf <> 0"
SQL["e14_diff_vs_reference"] = _DIFF.format("first", "tipo_ord") + " UNION ALL " + _DIFF.format("max", "baremo DESC NULLS LAST, tipo_ord")
SQL["e15_predominant"] = "SELECT form_id, tipo, baremo FROM (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY baremo DESC, tipo_ord) AS k FROM normed WHERE baremo IS NOT NULL) WHERE k = 1"
SQL["e16_manual_order"] = "SELECT form_id, tipo, CAST(row_number() OVER (PARTITION BY form_id ORDER BY CASE WHEN tipo_ord = 3 THEN 999 ELSE tipo_ord * 5 % 7 END, tipo_ord) AS INT) AS lugar FROM normed"
_QUICK = f"""{_LV}, tq AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY pd DESC, tipo_ord) AS ix FROM lv), ar AS (SELECT form_id, max(tipo) FILTER (ix = 1) AS area_1, max(tipo) FILTER (ix = 2) AS area_2 FROM tq GROUP BY form_id),
 cq AS (SELECT form_id, carrera, min(ix * 1000 + ord) AS o FROM tq JOIN career_types ct ON ct.tipo = tq.tipo WHERE ix <= 2 GROUP BY form_id, carrera), lq AS (SELECT form_id, (list(carrera ORDER BY o))[1:4] AS cs FROM cq GROUP BY form_id),
 qk AS (SELECT ar.form_id, area_1, area_2, coalesce(cs, []) AS cs, CASE WHEN e = 'alto' AND l = 'alto' THEN 'ALTO' WHEN e IN ('medio', 'alto') THEN 'MEDIO' ELSE 'BAJO' END AS potencial FROM ar LEFT JOIN lq ON lq.form_id = ar.form_id JOIN pt ON pt.form_id = ar.form_id)"""
SQL["e17_quick_report"] = f"WITH {_QUICK} SELECT form_id, area_1, area_2, array_to_string(cs, ',') AS carreras_top, potencial FROM qk"
SQL["e18_level_grid"] = f"WITH {_LV} SELECT form_id, " + ", ".join(f"max(CASE WHEN tipo = '{t}' AND nivel = '{n}' THEN 1 ELSE 0 END) AS {t}_{n}" for t in _T for n in ("bajo", "medio", "alto")) + " FROM lv GROUP BY form_id"
SQL["e19_report_record"] = f"""WITH {_QUICK} SELECT f.form_id, f.nombre AS campo_nombre, CAST(f.edad AS VARCHAR) AS campo_edad, f.sexo AS campo_genero, CASE f.form_id % 3 WHEN 0 THEN '5°' WHEN 1 THEN '4°' ELSE '' END AS campo_grado_instruccion,
 potencial AS potencial_puesto, coalesce(upper(area_1), '') AS campo_areas, coalesce(upper(area_2), '') AS campo_areas_2, coalesce(upper(cs[1]), '') AS campo_carreras, coalesce(upper(cs[2]), '') AS campo_carreras_2 FROM forms f JOIN qk ON qk.form_id = f.form_id"""
SQL["e20_plot_series"] = f"WITH {_LV} SELECT form_id, tipo, coalesce(baremo, 0) AS valor, nivel, CAST(row_number() OVER (PARTITION BY form_id ORDER BY coalesce(baremo, 0) DESC, tipo_ord) AS INT) AS lugar, greatest(70, max(coalesce(baremo, 0)) OVER (PARTITION BY form_id)) + 10 AS eje_max FROM lv"
SQL["e21_score_forms"] = f"""WITH {_LV}, r AS (SELECT *, {_LEVEL} AS nv FROM ranked) SELECT r.form_id, max(r.tipo) FILTER (posicion = 1) AS tipo1, max(r.pd) FILTER (posicion = 1) AS pd1, max(r.baremo) FILTER (posicion = 1) AS baremo1, max(nv) FILTER (posicion = 1) AS nivel1,
 max(r.tipo) FILTER (posicion = 2) AS tipo2, max(r.pd) FILTER (posicion = 2) AS pd2, max(r.baremo) FILTER (posicion = 2) AS baremo2, max(nv) FILTER (posicion = 2) AS nivel2, CASE any_value(e) WHEN 'alto' THEN 'ALTO' WHEN 'medio' THEN 'MEDIO' ELSE 'BAJO' END AS potencial FROM r JOIN pt ON pt.form_id = r.form_id GROUP BY r.form_id"""

SQL["f1_career_index"] = "SELECT DISTINCT carrera, tipo, 'unico' AS modo FROM career_types UNION ALL (SELECT carrera, tipo, 'compat' FROM career_types UNION SELECT carrera, alias, 'compat' FROM career_types c JOIN type_alias a ON a.tipo = c.tipo)"
SQL["f2_symmetric_rules"] = """WITH al AS (SELECT a, b, razon, ord FROM pair_rules UNION ALL SELECT b, a, 'later', ord + 100 FROM pair_rules WHERE ord % 8 = 0), bo AS (SELECT * FROM al UNION ALL SELECT b, a, razon, ord FROM al)
SELECT a, b, arg_max(razon, ord) AS razon FROM bo GROUP BY a, b"""
SQL["f3_pair_affinity"] = f"WITH {_PAIRS} SELECT tipo_a, tipo_b, a, b, puntaje, relacion FROM sp"
SQL["f4_type_pairs"] = f"WITH {_TP} SELECT tipo_a, tipo_b, a, b FROM tp"
SQL["f5_best_two_pairs"] = f"WITH {_BEST} SELECT * FROM best"
SQL["f6_suggest"] = f"WITH {_SUG} SELECT * FROM sug"
_NORM = "trim(regexp_replace(lower(translate({0}, 'áàäâãéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ', 'aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
SQL["f7_normalize_text"] = f"""WITH t AS (SELECT form_id, texto || '  Ñandú-É# Ő ř ǎ Š ' || form_id AS x FROM texts) SELECT form_id, {_NORM.format('x')} AS map, trim(regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', ' ', 'g')) AS strip FROM t"""
_BA = f"""{_AFF}, pq AS (SELECT a.carrera AS a, b.carrera AS b FROM careers a JOIN careers b ON a.carrera_id = (b.carrera_id * 5) % 61), pt2 AS (SELECT DISTINCT x.tipo AS tipo_a, y.tipo AS tipo_b, a, b FROM pq JOIN career_types x ON x.carrera = a JOIN career_types y ON y.carrera = b), s2 AS ({_SCORE.format('pt2')})"""
SQL["f8_best_affinity"] = f"WITH {_BA} SELECT tipo_a, tipo_b, a, b, puntaje, relacion FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY puntaje DESC, tipo_a, tipo_b) AS k FROM s2) WHERE k = 1"
SQL["f9_verdict"] = f"WITH {_PAIRS} SELECT tipo_a, tipo_b, a, b, CASE WHEN puntaje >= 10 THEN 'alta' WHEN puntaje >= 5 THEN 'media' ELSE 'baja' END AS veredicto FROM sp"
_RES = f"""qs AS (SELECT DISTINCT {_NORM.format('texto')} AS q FROM texts WHERE {_NORM.format('texto')} <> ''), al AS (SELECT {_NORM.format('alias')} AS q, max(carrera) AS carrera FROM aliases GROUP BY 1),
 nm AS (SELECT {_NORM.format('carrera')} AS q, carrera FROM careers), kw AS (SELECT DISTINCT {_NORM.format('palabra')} AS q, carrera FROM career_keywords),
 vr AS (SELECT q, 1 AS ix, CASE WHEN ends_with(q, 'es') AND length(q) > 4 THEN left(q, length(q) - 2) END AS v FROM qs UNION ALL SELECT q, 2, CASE WHEN ends_with(q, 's') AND length(q) > 3 THEN left(q, length(q) - 1) END FROM qs UNION ALL SELECT q, 3, q || 's' FROM qs),
 tk AS (SELECT carrera, unnest(string_split(q, ' ')) AS t FROM nm), tq2 AS (SELECT q, unnest(string_split(q, ' ')) AS t FROM qs),
 ti AS (SELECT qs.q, al.carrera, 1 AS paso, row_number() OVER (PARTITION BY qs.q) AS k FROM qs JOIN al ON al.q = qs.q
  UNION ALL SELECT vr.q, al.carrera, 2, row_number() OVER (PARTITION BY vr.q ORDER BY ix) FROM vr JOIN al ON al.q = vr.v
  UNION ALL SELECT qs.q, nm.carrera, 3, row_number() OVER (PARTITION BY qs.q ORDER BY nm.carrera) FROM qs JOIN nm ON nm.q = qs.q
  UNION ALL SELECT qs.q, kw.carrera, 4, row_number() OVER (PARTITION BY qs.q ORDER BY length(kw.carrera), kw.carrera) FROM qs JOIN kw ON kw.q = qs.q
  UNION ALL SELECT q, carrera, 5, row_number() OVER (PARTITION BY q ORDER BY n DESC, length(carrera), carrera) FROM (SELECT q, carrera, count(*) AS n FROM tq2 JOIN (SELECT DISTINCT * FROM tk) tk ON tk.t = tq2.t WHERE length(tq2.t) >= 4 GROUP BY q, carrera)),
 res AS (SELECT q, arg_min(carrera, paso) AS carrera, min(paso) AS paso FROM ti WHERE k = 1 GROUP BY q)"""
_RESF = f"""{_RES}, lf AS (SELECT q FROM qs WHERE length(q) >= 4 AND q NOT IN (SELECT q FROM res)), nw AS (SELECT carrera, q AS w FROM nm UNION SELECT carrera, t FROM tk WHERE length(t) >= 5),
 {_ratio('rf', f"SELECT DISTINCT lf.q AS a, nw.w AS b FROM lf, nw WHERE {_REACH.format('lf.q', 'nw.w', '0.72D')}")},
 resf AS (SELECT q, carrera, CAST(paso AS INT) AS paso FROM res UNION ALL SELECT a, carrera, 6 FROM (SELECT a, carrera, row_number() OVER (PARTITION BY a ORDER BY sim DESC, carrera) AS k FROM rf JOIN nw ON nw.w = rf.b WHERE sim >= 0.72D) WHERE k = 1)"""
SQL["f10_resolve_names_fuzzy"] = f"WITH {_RESF} SELECT q AS texto_norm, carrera, paso FROM resf"
SQL["f10_resolve_names"] = f"WITH {_RES} SELECT q AS texto_norm, carrera, CAST(paso AS INT) AS paso FROM res"
SQL["f11_analyze_written"] = f"""WITH {_SUG}, {_RESF}, wr AS (SELECT form_id, ord, texto, {_NORM.format('texto')} AS q FROM proposals), w2 AS (SELECT wr.*, resf.carrera FROM wr LEFT JOIN resf ON resf.q = wr.q),
 ab AS (SELECT DISTINCT w2.form_id, w2.ord, w2.carrera AS a, sug.carrera AS b FROM w2 JOIN sug ON sug.form_id = w2.form_id WHERE w2.carrera IS NOT NULL), dp AS (SELECT DISTINCT a, b FROM ab),
 tt AS (SELECT DISTINCT x.tipo AS tipo_a, y.tipo AS tipo_b, a, b FROM dp JOIN career_types x ON x.carrera = a JOIN career_types y ON y.carrera = b), sc AS ({_SCORE.format('tt')}),
 bb AS (SELECT a, b, puntaje, relacion FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY puntaje DESC, tipo_a, tipo_b) AS k FROM sc) WHERE k = 1),
 mt AS (SELECT * FROM (SELECT ab.form_id, ab.ord, ab.b, puntaje, relacion, row_number() OVER (PARTITION BY ab.form_id, ab.ord ORDER BY puntaje DESC, ab.b) AS k FROM ab JOIN bb ON bb.a = ab.a AND bb.b = ab.b) WHERE k = 1)
SELECT w2.form_id, w2.ord, texto, CASE WHEN trim(texto) = '' THEN 'vacio' WHEN carrera IS NULL THEN 'no_reconocida' WHEN puntaje IS NULL THEN 'sin_match' ELSE 'analizada' END AS estado, carrera, b AS carrera_test, puntaje, relacion,
 CASE WHEN trim(texto) = '' THEN NULL WHEN carrera IS NULL THEN 'desconocida' WHEN puntaje >= 10 THEN 'alta' WHEN puntaje >= 5 THEN 'media' ELSE 'baja' END AS veredicto, coalesce(puntaje >= 10, false) AS afinidad_alta FROM w2 LEFT JOIN mt ON mt.form_id = w2.form_id AND mt.ord = w2.ord"""
_CN = f"""ct0 AS (SELECT DISTINCT trim(texto) AS t FROM texts WHERE trim(texto) <> ''), ce AS (SELECT t, min(carrera) AS carrera FROM ct0 JOIN careers ON lower(carrera) = lower(t) GROUP BY t),
 {_ratio('cr', f"SELECT carrera AS a, t AS b FROM ct0, careers WHERE t NOT IN (SELECT t FROM ce) AND {_REACH.format('t', 'carrera', '0.62D')}")},
 cb AS (SELECT * FROM ce UNION ALL SELECT b, a FROM (SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY sim DESC, a DESC) AS k FROM cr WHERE sim >= 0.62D) WHERE k = 1),
 cn AS (SELECT t, carrera FROM ct0 LEFT JOIN cb USING (t))"""
SQL["f12_closest_name"] = f"WITH {_CN} SELECT t AS texto, carrera FROM cn"
SQL["f13_similarity"] = f"""WITH sq AS (SELECT t.form_id, lower(texto) AS x, c.carrera FROM texts t JOIN careers c ON c.carrera_id = 1 + t.form_id % 60), {_ratio('sr', "SELECT DISTINCT x AS a, carrera AS b FROM sq")}
SELECT form_id, round(sim, 6) AS bloques, round(1.0D - levenshtein(x, carrera) / CAST(greatest(length(x), length(carrera)) AS DOUBLE), 6) AS edicion FROM sq JOIN sr ON sr.a = x AND sr.b = carrera"""
SQL["f13_edit_ratio"] = "SELECT t.form_id, round(CASE WHEN greatest(length(texto), length(carrera)) = 0 THEN 1.0D ELSE 1.0D - levenshtein(lower(texto), carrera) / CAST(greatest(length(texto), length(carrera)) AS DOUBLE) END, 6) AS edicion FROM texts t JOIN careers c ON c.carrera_id = 1 + t.form_id % 60"

_INDEX = f"""{_CATALOG}, ia AS (SELECT alias, max(ord) AS ord FROM (SELECT {_NORM.format('carrera')} AS alias, ord FROM cat UNION ALL SELECT unnest(alias), ord FROM cat) GROUP BY alias), ip AS (SELECT ord, unnest(keywords) AS frase FROM cat),
 it AS (SELECT DISTINCT ord, unnest(string_split(frase, ' ')) AS token FROM ip), ik AS (SELECT * FROM it WHERE length(token) >= 3)"""
SQL["g1_search_index"] = f"WITH {_INDEX} SELECT 'alias' AS indice, alias AS clave, ord FROM ia UNION ALL SELECT 'phrase', frase, ord FROM ip UNION ALL SELECT 'token', token, ord FROM ik"
_STEM = "CASE WHEN length({0}) <= 3 THEN {0} WHEN ends_with({0}, 'es') AND length({0}) > 4 THEN left({0}, length({0}) - 2) WHEN ends_with({0}, 's') THEN left({0}, length({0}) - 1) ELSE {0} END"
SQL["g2_stem"] = f"SELECT w, {_STEM.format('w')} AS raiz FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM documents) WHERE w <> ''"
_EXP = f"""tw AS (SELECT DISTINCT q, unnest(string_split(q, ' ')) AS token FROM (SELECT {_NORM.format('texto')} AS q FROM texts)), tl AS (SELECT q, token, {_STEM.format('token')} AS st FROM tw WHERE length(token) >= 3),
 ex AS (SELECT q, token FROM tl UNION SELECT q, st FROM tl UNION SELECT q, expansion FROM tl JOIN expansions e ON e.token IN (tl.token, tl.st, tl.st || 's'))"""
SQL["g3_expand_tokens"] = f"WITH {_EXP} SELECT q, token FROM ex"
_SEARCH = f"""{_INDEX}, {_EXP}, qa AS (SELECT DISTINCT {_NORM.format('texto')} AS q FROM texts WHERE {_NORM.format('texto')} <> ''), s1 AS (SELECT qa.q, ia.ord, 1.0D AS score, 1 AS nivel FROM qa JOIN ia ON ia.alias = qa.q), rs AS (SELECT q FROM qa WHERE q NOT IN (SELECT q FROM s1)),
 nt AS (SELECT rs.q, len([w for w in string_split(rs.q, ' ') if length(w) >= 3]) AS n FROM rs),
 ht AS (SELECT ex.q, ik.ord, 1.0D AS p FROM ex JOIN ik ON ik.token = ex.token WHERE ex.q IN (SELECT q FROM rs) UNION ALL SELECT rs.q, ip.ord, 2.0D FROM rs JOIN ip ON ip.frase = rs.q WHERE rs.q IN (SELECT q FROM tl)),
 hs AS (SELECT ht.q, ht.ord, sum(p) / any_value(n) AS score FROM ht JOIN nt ON nt.q = ht.q GROUP BY ht.q, ht.ord), hb AS (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM hs),
 s2 AS (SELECT * FROM s1 UNION ALL SELECT q, ord, score, 2 FROM hb WHERE best >= 0.34D)"""
_PLACED = "row_number() OVER (PARTITION BY q ORDER BY score DESC, ord) AS lugar"
_FOUND = "SELECT q, ord, round(score, 6) AS score, CAST(nivel AS INT) AS nivel, CAST(lugar AS INT) AS lugar FROM {0} WHERE lugar <= 3"
SQL["g4_search"] = f"WITH {_SEARCH}, sr AS (SELECT *, {_PLACED} FROM s2) {_FOUND.format('sr')}"
_SEARCHF = f"""{_SEARCH}, ph AS (SELECT ord, 0 AS kind, 0 AS pos, {_NORM.format('carrera')} AS x FROM cat UNION ALL SELECT ord, 1, i, alias[i] FROM (SELECT ord, alias, unnest(range(1, len(alias) + 1)) AS i FROM cat) UNION ALL SELECT ord, 2, i, keywords[i] FROM (SELECT ord, keywords, unnest(range(1, len(keywords) + 1)) AS i FROM cat)),
 fc AS (SELECT q, ord FROM (SELECT q, ord, {_PLACED} FROM hb WHERE best < 0.34D) WHERE lugar <= 8 UNION ALL SELECT rs.q, cat.ord FROM rs, cat WHERE rs.q NOT IN (SELECT q FROM hs)),
 {_ratio('fz', f"SELECT DISTINCT fc.q AS a, ph.x AS b FROM fc JOIN ph ON ph.ord = fc.ord WHERE {_REACH.format('fc.q', 'ph.x', '0.78D')}")},
 fs AS (SELECT fc.q, fc.ord, kind, pos, sim, coalesce(max(CASE WHEN kind = 0 THEN sim END) OVER (PARTITION BY fc.q, fc.ord), 0.0D) AS named FROM fc JOIN ph ON ph.ord = fc.ord JOIN fz ON fz.a = fc.q AND fz.b = ph.x),
 ft AS (SELECT *, min(CASE WHEN kind = 1 AND sim >= 0.85D AND sim > named THEN pos END) OVER (PARTITION BY q, ord) AS stop FROM fs),
 s3 AS (SELECT q, ord, max(sim) * 0.9D AS score, 3 AS nivel FROM ft WHERE kind <> 1 OR stop IS NULL OR pos <= stop GROUP BY q, ord HAVING max(sim) >= 0.78D),
 sr AS (SELECT *, {_PLACED} FROM (SELECT * FROM s2 UNION ALL SELECT * FROM s3))"""
SQL["g5_search_fuzzy"] = f"WITH {_SEARCHF} {_FOUND.format('sr')}"
_COS = """cu AS (SELECT ord, carrera, nivel, institucion, CASE WHEN m < 1e-9 THEN 0.0D ELSE r / m END AS r, CASE WHEN m < 1e-9 THEN 0.0D ELSE i / m END AS i, CASE WHEN m < 1e-9 THEN 0.0D ELSE a / m END AS a, CASE WHEN m < 1e-9 THEN 0.0D ELSE s / m END AS s, CASE WHEN m < 1e-9 THEN 0.0D ELSE e / m END AS e, CASE WHEN m < 1e-9 THEN 0.0D ELSE c / m END AS c FROM (SELECT *, sqrt(r*r + i*i + a*a + s*s + e*e + c*c) AS m FROM cat)),
 pu AS (SELECT form_id, r / m AS r, i / m AS i, a / m AS a, s / m AS s, e / m AS e, c / m AS c FROM (SELECT *, sqrt(r*r + i*i + a*a + s*s + e*e + c*c) AS m FROM person_profiles))"""
_DOT = "({0}.r * {1}.r + {0}.i * {1}.i + {0}.a * {1}.a + {0}.s * {1}.s + {0}.e * {1}.e + {0}.c * {1}.c)"
SQL["g6_cosine_affinity"] = f"WITH {_CATALOG}, {_COS} SELECT form_id, ord, round({_DOT.format('pu', 'cu')}, 6) AS afinidad FROM pu, cu"
_CTX = "greatest(0.0D, least(1.0D, 0.5D + CASE WHEN {0} IS NULL THEN 0.0D WHEN list_contains(cu.nivel, {0}) THEN 0.25D ELSE -0.20D END + CASE WHEN {1} IS NULL THEN 0.0D WHEN list_contains(cu.institucion, {1}) THEN 0.25D ELSE -0.15D END))"
_REC = f"""{_SEARCHF}, {_COS}, rq AS (SELECT p.form_id, texto, {_NORM.format('texto')} AS q, CASE WHEN nivel_max <> 'sin_especificar' THEN nivel_max END AS n, CASE WHEN institucion <> 'indiferente' THEN institucion END AS t FROM proposals p JOIN prefs f ON f.form_id = p.form_id),
 r1 AS (SELECT rq.form_id, sr.ord, cu.carrera, texto, {_DOT.format('pu', 'cu')} AS afinidad, sr.score AS "match", {_CTX.format('rq.n', 'rq.t')} AS contexto FROM rq JOIN sr ON sr.q = rq.q AND sr.lugar <= 3 AND sr.score >= 0.30D JOIN cu ON cu.ord = sr.ord JOIN pu ON pu.form_id = rq.form_id),
 r2 AS (SELECT *, 0.55D * afinidad + 0.30D * "match" + 0.15D * contexto AS score FROM r1), r3 AS (SELECT *, row_number() OVER (PARTITION BY form_id, ord ORDER BY score DESC, texto) AS k FROM r2),
 rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY score DESC, ord) AS lugar FROM r3 WHERE k = 1) WHERE lugar <= 3)"""
SQL["g7_context_score"] = f"WITH {_REC} SELECT DISTINCT rq.form_id, sr.ord, round({_CTX.format('rq.n', 'rq.t')}, 6) AS contexto FROM rq JOIN sr ON sr.q = rq.q AND sr.lugar <= 3 JOIN cu ON cu.ord = sr.ord"
SQL["g8_recommend"] = f'WITH {_REC} SELECT form_id, CAST(lugar AS INT) AS lugar, ord, texto, round(afinidad, 6) AS afinidad, round("match", 6) AS "match", round(contexto, 6) AS contexto, round(score, 6) AS score FROM rec'
SQL["g9_coherence"] = f"""WITH {_REC}, pq AS (SELECT x.form_id, avg({_DOT.format('cx', 'cy')}) AS m FROM rec x JOIN rec y ON y.form_id = x.form_id AND x.lugar < y.lugar JOIN cu cx ON cx.ord = x.ord JOIN cu cy ON cy.ord = y.ord GROUP BY x.form_id)
SELECT f.form_id, round(coalesce(pq.m, 0.5D), 6) AS coherencia FROM (SELECT DISTINCT form_id FROM rec) f LEFT JOIN pq ON pq.form_id = f.form_id"""
SQL["g10_conflict_alert"] = f"WITH {_REC} SELECT form_id, afinidad < 0.60D AS alerta FROM rec WHERE lugar = 1"
_SAID = "'" + "' || texto || '".join(x.replace("'", "''") for x in NOT_FOUND.split("%s")) + "'"
SQL["g11_unmatched"] = f"""WITH {_SEARCHF}, {_COS}, lo AS (SELECT p.form_id, p.texto FROM proposals p WHERE trim(p.texto) <> '' AND {_NORM.format('p.texto')} NOT IN (SELECT q FROM sr WHERE lugar <= 3 AND score >= 0.30D)),
 aq AS (SELECT form_id, carrera, ord, round({_DOT.format('pu', 'cu')}, 9) AS afinidad FROM pu, cu WHERE form_id IN (SELECT form_id FROM lo)), af AS (SELECT form_id, carrera, afinidad, row_number() OVER (PARTITION BY form_id ORDER BY afinidad DESC, ord) AS k FROM aq)
SELECT lo.form_id, lo.texto, {_SAID} AS mensaje, CAST(k AS INT) AS lugar, carrera, round(afinidad, 6) AS afinidad FROM lo LEFT JOIN (SELECT * FROM af WHERE k <= 3) a ON a.form_id = lo.form_id"""
# The main catalogue has the recommended names themselves.
SQL["g15_interpret"] = f"""WITH {_REC.replace('WHERE lugar <= 3)', 'WHERE lugar <= 5)')}, vl AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY lugar) AS v FROM rec WHERE "match" >= 0.30D)
SELECT form_id, CAST(v AS INT) AS lugar, carrera, round("match", 6) AS "match", round(afinidad, 6) AS afinidad, round(score, 6) AS score FROM vl"""
_SAY = {k: v.replace("'", "''") for k, v in SENTENCES.items()}
_AREA = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in AREAS.items()) + " END"
SQL["g12_explain"] = f"""WITH {_REC}, pq AS (SELECT x.form_id, avg({_DOT.format('cx', 'cy')}) AS m FROM rec x JOIN rec y ON y.form_id = x.form_id AND x.lugar < y.lugar JOIN cu cx ON cx.ord = x.ord JOIN cu cy ON cy.ord = y.ord GROUP BY x.form_id),
 lt AS (SELECT form_id, unnest(['r', 'i', 'a', 's', 'e', 'c']) AS l, unnest([r, i, a, s, e, c]) AS x, unnest([0, 1, 2, 3, 4, 5]) AS ix FROM person_profiles), lo2 AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY x DESC, ix) AS k FROM lt),
 ar AS (SELECT form_id, max({_AREA.format('l')}) FILTER (k = 1) AS n1, max(x) FILTER (k = 1) AS x1, max({_AREA.format('l')}) FILTER (k = 2) AS n2, max(x) FILTER (k = 2) AS x2 FROM lo2 GROUP BY form_id),
 ch AS (SELECT form_id, max(carrera) FILTER (lugar = 1) AS c1, max(afinidad) FILTER (lugar = 1) AS a1, max("match") FILTER (lugar = 1) AS m1, max(carrera) FILTER (lugar = 2) AS c2, max(afinidad) FILTER (lugar = 2) AS a2 FROM rec GROUP BY form_id)
SELECT ar.form_id, CASE WHEN c1 IS NULL THEN '{_SAY['none']}' ELSE concat_ws(' ', printf('{_SAY['areas']}', n1, x1, n2, x2), printf('{_SAY['first']}', c1, a1, m1), CASE WHEN c2 IS NOT NULL THEN printf('{_SAY['second']}', c2, a2) END, CASE WHEN a1 < 0.60D THEN '{_SAY['alert']}' END,
 CASE WHEN coalesce(m, 0.5D) < 0.55D THEN printf('{_SAY['apart']}', coalesce(m, 0.5D)) WHEN m > 0.80D THEN printf('{_SAY['together']}', m) END) END AS razonamiento FROM ar LEFT JOIN ch ON ch.form_id = ar.form_id LEFT JOIN pq ON pq.form_id = ar.form_id"""
SQL["g13_empty_requests"] = "SELECT form_id, 0.0D AS coherencia, 'No ingresaste ninguna carrera para evaluar.' AS mensaje FROM forms WHERE form_id NOT IN (SELECT form_id FROM texts WHERE trim(texto) <> '')"
SQL["g14_recommend_once"] = SQL["g8_recommend"]
SQL["g14_dedupe_requests"] = "SELECT texto, CASE WHEN nivel_max <> 'sin_especificar' THEN nivel_max END AS nivel, CASE WHEN institucion <> 'indiferente' THEN institucion END AS institucion, count(*) AS n FROM proposals p JOIN prefs f ON f.form_id = p.form_id GROUP BY 1, 2, 3"

_LVL = "cl2 AS (SELECT carrera, CASE WHEN carrera_id % 9 = 0 THEN 'cetpro' WHEN carrera_id % 9 IN (1, 2) THEN 'tecnico' ELSE 'universitario' END AS nivel FROM careers)"
SQL["h1_career_level"] = f"WITH {_LVL} SELECT carrera, nivel FROM cl2"
_RANK = "CASE {0} WHEN 'cetpro' THEN 1 WHEN 'tecnico' THEN 2 ELSE 3 END"
_AFFORD = f"CASE WHEN nivel_max <> 'sin_especificar' AND {_RANK.format('nivel')} > {_RANK.format('nivel_max')} THEN 'nivel' WHEN institucion <> 'indiferente' AND carrera IN (SELECT carrera FROM institutions) AND carrera || institucion NOT IN (SELECT carrera || institucion FROM institutions) THEN 'institucion' END"
SQL["h2_affordable"] = f"""WITH {_LVL}, d AS (SELECT p.form_id, c.carrera, coalesce(cl2.nivel, 'universitario') AS nivel, nivel_max, institucion FROM prefs p LEFT JOIN careers c ON c.carrera_id = 1 + p.form_id % 64 LEFT JOIN cl2 ON cl2.carrera = c.carrera),
 e AS (SELECT form_id, carrera, {_AFFORD} AS descarte FROM d) SELECT form_id, carrera, descarte IS NULL AS financiable, descarte FROM e"""
_TS = "ty AS (SELECT carrera, list_distinct(list(tipo)) AS ts FROM career_types GROUP BY carrera), rl2 AS (SELECT tipo, list(rel) AS rs FROM related_types GROUP BY tipo)"
_VOC = "CAST(8 * CAST(list_contains(ty.ts, {0}.tipo1) AS INT) + 8 * CAST(list_contains(ty.ts, {0}.tipo2) AS INT) + 4 * CAST(list_contains(ty.ts, {0}.tipo1) AND list_contains(ty.ts, {0}.tipo2) AS INT) + 2 * len(list_intersect(ra.rs, ty.ts)) + 2 * len(list_intersect(rb.rs, ty.ts)) AS INT)"
SQL["h3_type_score"] = f"WITH {_TS} SELECT t.form_id, c.carrera, t.tipo1, t.tipo2, {_VOC.format('t')} AS s_voc FROM tops t JOIN careers c ON c.carrera_id = 1 + t.form_id % 60 JOIN ty ON ty.carrera = c.carrera LEFT JOIN rl2 ra ON ra.tipo = t.tipo1 LEFT JOIN rl2 rb ON rb.tipo = t.tipo2"
_SIM = """sim AS (SELECT x.carrera AS a, y.carrera AS b, CASE WHEN x.carrera = y.carrera THEN 0.0D ELSE CAST(CASE WHEN len(list_intersect(gx.gs, gy.gs)) > 0 THEN 4 ELSE 0 END + 2 * least(len(list_intersect(kx.ks, ky.ks)), 3) + 3 * len(list_intersect(tx.ts, ty2.ts)) AS DOUBLE) END AS similitud
 FROM careers x CROSS JOIN careers y JOIN g2 gx ON gx.carrera = x.carrera JOIN g2 gy ON gy.carrera = y.carrera JOIN k2 kx ON kx.carrera = x.carrera JOIN k2 ky ON ky.carrera = y.carrera JOIN ty tx ON tx.carrera = x.carrera JOIN ty ty2 ON ty2.carrera = y.carrera)"""
_FREE = f"""{_SEARCHF}, {_COS}, {_CN}, pw AS (SELECT p.form_id, p.ord, trim(p.texto) AS t, {_NORM.format('p.texto')} AS q, cn.carrera AS named FROM proposals p JOIN cn ON cn.t = trim(p.texto)),
 fr AS (SELECT pw.form_id, pw.ord AS ix, cu.ord, cu.carrera, {_DOT.format('pu', 'cu')} AS afinidad, sr.score AS "match" FROM pw JOIN sr ON sr.q = pw.q AND sr.lugar <= 3 AND sr.score >= 0.30D JOIN cu ON cu.ord = sr.ord JOIN pu ON pu.form_id = pw.form_id WHERE named IS NULL),
 fp AS (SELECT *, 0.55D * afinidad + 0.30D * "match" + 0.15D * 0.5D AS score, row_number() OVER (PARTITION BY form_id, ix ORDER BY 0.55D * afinidad + 0.30D * "match" + 0.15D * 0.5D DESC, ord) AS k FROM fr),
 fi AS (SELECT form_id, ix, max(carrera) FILTER (k = 1) AS carrera, max("match") FILTER (k = 1) AS "match", max(afinidad) FILTER (k = 1) AS afinidad, max(score) FILTER (k = 1) AS score, coalesce(string_agg(carrera, ',' ORDER BY k) FILTER (k > 1), '') AS alternativas FROM fp GROUP BY form_id, ix),
 rp AS (SELECT pw.form_id, pw.ord, pw.t AS texto, CASE WHEN named IS NOT NULL THEN 'nombre' WHEN fi.carrera IS NOT NULL THEN 'interpretada' ELSE 'no_encontrada' END AS origen, coalesce(named, fi.carrera) AS carrera, "match", afinidad, score, alternativas FROM pw LEFT JOIN fi ON fi.form_id = pw.form_id AND fi.ix = pw.ord)"""
SQL["h8_proposals"] = f'WITH {_FREE} SELECT form_id, ord, texto, origen, carrera, round("match", 6) AS "match", round(afinidad, 6) AS afinidad, round(score, 6) AS score, alternativas FROM rp'
_CAND = f"""{_SUG}, {_FREE}, {_TS}, {_SIM}, prp AS (SELECT form_id, carrera, min(ord) AS ord FROM rp WHERE carrera IS NOT NULL GROUP BY form_id, carrera),
 tst AS (SELECT s.form_id, carrera, CASE WHEN es_principal THEN 0 ELSE 2 END + CASE WHEN s.tipo = t.tipo1 THEN 1 ELSE 2 END AS ord FROM sug s JOIN tops t ON t.form_id = s.form_id),
 un AS (SELECT form_id, carrera, min(o) AS o, bool_or(o < 100) AS en_test, bool_or(o >= 100) AS en_alumno FROM (SELECT form_id, carrera, ord AS o FROM tst UNION ALL SELECT form_id, carrera, 100 + ord FROM prp) GROUP BY form_id, carrera),
 cand AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY o, carrera) AS ord FROM un)"""
_MEAN = "(SELECT avg(similitud) FROM {0} l JOIN sim ON sim.a = c.carrera AND sim.b = l.carrera WHERE l.form_id = c.form_id AND l.carrera <> c.carrera)"
SQL["h4_career_similarity"] = f"WITH {_CAND} SELECT DISTINCT a, b, similitud FROM cand x JOIN cand y ON y.form_id = x.form_id AND y.carrera <> x.carrera JOIN sim ON sim.a = x.carrera AND sim.b = y.carrera"
SQL["h5_list_affinity"] = f"WITH {_CAND} SELECT c.form_id, c.carrera, round(coalesce(m, 0.0D), 6) AS afinidad FROM tst c LEFT JOIN (SELECT c.form_id, c.carrera, avg(similitud) AS m FROM tst c JOIN prp l ON l.form_id = c.form_id AND l.carrera <> c.carrera JOIN sim ON sim.a = c.carrera AND sim.b = l.carrera GROUP BY ALL) x ON x.form_id = c.form_id AND x.carrera = c.carrera"
_SCD = f"""{_CAND}, ma AS (SELECT c.form_id, c.carrera, avg(similitud) AS m FROM cand c JOIN prp l ON l.form_id = c.form_id AND l.carrera <> c.carrera JOIN sim ON sim.a = c.carrera AND sim.b = l.carrera GROUP BY ALL),
 mb AS (SELECT c.form_id, c.carrera, avg(similitud) AS m FROM cand c JOIN tst l ON l.form_id = c.form_id AND l.carrera <> c.carrera JOIN sim ON sim.a = c.carrera AND sim.b = l.carrera GROUP BY ALL),
 sd0 AS (SELECT c.*, {_VOC.format('t')} AS s_voc, coalesce(ma.m, 0.0D) AS s_prop, coalesce(mb.m, 0.0D) AS s_test FROM cand c JOIN tops t ON t.form_id = c.form_id JOIN ty ON ty.carrera = c.carrera LEFT JOIN rl2 ra ON ra.tipo = t.tipo1 LEFT JOIN rl2 rb ON rb.tipo = t.tipo2
  LEFT JOIN ma ON ma.form_id = c.form_id AND ma.carrera = c.carrera LEFT JOIN mb ON mb.form_id = c.form_id AND mb.carrera = c.carrera),
 sd AS (SELECT *, round_even(s_voc * 1.0D + s_prop * 2.5D + s_test * 0.8D + CASE WHEN en_alumno THEN 20 ELSE 0 END + CASE WHEN en_test THEN 5 ELSE 0 END, 1) AS score FROM sd0)"""
SQL["h6_career_score"] = f"WITH {_SCD} SELECT form_id, carrera, s_voc, round(s_prop, 6) AS s_prop, round(s_test, 6) AS s_test, round(score, 6) AS score FROM sd"
SQL["h7_universe"] = f"WITH {_CAND} SELECT form_id, carrera, CAST(ord AS INT) AS ord, en_test, en_alumno FROM cand"
_EV = f"""{_SCD}, {_LVL}, ev0 AS (SELECT sd.*, cl2.nivel, nivel_max, institucion FROM sd LEFT JOIN cl2 ON cl2.carrera = sd.carrera JOIN prefs ON prefs.form_id = sd.form_id), ev1 AS (SELECT *, {_AFFORD} AS descarte FROM ev0),
 ev2 AS (SELECT *, row_number() OVER (PARTITION BY form_id, descarte IS NULL ORDER BY score DESC, ord) AS k FROM ev1), ev AS (SELECT *, CASE WHEN descarte IS NOT NULL THEN 'descartada' WHEN k <= 2 THEN 'final' ELSE 'reserva' END AS estado FROM ev2)"""
SQL["h8_evaluate"] = f"WITH {_EV} SELECT form_id, carrera, score, estado, CASE WHEN estado = 'final' THEN CAST(k AS INT) END AS rank, descarte FROM ev"
SQL["h9_final_view"] = f"""WITH {_EV} SELECT form_id, CAST(k AS INT) AS rank, carrera, CASE WHEN en_test AND en_alumno THEN 'sintesis' WHEN en_alumno THEN 'alumno' ELSE 'test' END AS origen,
 CAST(least(100, floor(score / CASE WHEN max(score) OVER (PARTITION BY form_id) = 0 THEN 1.0D ELSE max(score) OVER (PARTITION BY form_id) END * 100)) AS INT) AS pct FROM ev WHERE estado = 'final'"""

SQL["m1_coverage_gaps"] = "SELECT carrera FROM careers WHERE carrera NOT IN (SELECT carrera FROM institutions)"
SQL["m2_mapping_profile"] = "WITH g AS (SELECT carrera, bool_or(institucion = 'publica') AS a, bool_or(institucion = 'privada') AS b FROM institutions GROUP BY carrera) SELECT count(*) FILTER (a AND NOT b) AS solo_publica, count(*) FILTER (b AND NOT a) AS solo_privada, count(*) FILTER (a AND b) AS ambas FROM g"
_CMP = "SELECT '{0}' AS columna, count(*) FILTER (form_id % 11 <> 0 AND form_id % 13 <> 0{1}) AS iguales, count(*) FILTER (form_id % 11 <> 0 AND form_id % 13 <> 0 AND {2}) AS distintos, count(*) FILTER (form_id % 11 <> 0 AND form_id % 13 = 0) AS solo_a, count(*) FILTER (form_id % 13 <> 0 AND form_id % 11 = 0) AS solo_b FROM ranked"
SQL["m3_compare_results"] = " UNION ALL ".join([_CMP.format("pd", " AND form_id % 5 <> 0", "form_id % 5 = 0"), _CMP.format("baremo", "", "false"), _CMP.format("posicion", "", "false")])
SQL["m4_run_stats"] = "SELECT stage, count(seconds) AS n, round(avg(seconds), 6) AS media, round(median(seconds), 6) AS mediana, round(min(seconds), 6) AS minimo, round(max(seconds), 6) AS maximo, round(coalesce(stddev_samp(seconds), 0.0D), 6) AS desviacion FROM run_log GROUP BY stage"
SQL["m5_throughput"] = "SELECT w AS trabajadores, round(w / m, 6) AS por_segundo FROM (SELECT avg(seconds) AS m FROM run_log) CROSS JOIN (SELECT unnest([1, 2, 4, 8]) AS w) x"
SQL["m6_missing_fields"] = "SELECT event_id, array_to_string(list_sort([x for x in ['nulo', 'u0', 'u1'] if (x = 'nulo' AND event_id % 2 <> 0) OR (x = 'u0' AND user_id % 3 <> 0) OR (x = 'u1' AND user_id % 3 <> 1)]), ',') AS faltan FROM events"


def oracle_sql() -> dict[str, str]:
    return {name: duck(sql) for name, sql in SQL.items()}
