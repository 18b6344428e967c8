"""Input views over the driver's tables: forms, answers, signals and catalogues, in SQL that Spark and DuckDB both read.

Every view is derived from the given tables by integer arithmetic and total
orders from whole tables and whole texts, so it grows with them and is the same on
both engines.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "forms": "SELECT c_custkey AS form_id, c_name AS nombre, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sexo, CAST(11 + c_custkey % 9 AS INT) AS edad, c_nationkey AS school FROM customer",
    "item_dim": """SELECT 'E' AS bloque, CAST(1 + r.r_regionkey * 25 + n.n_nationkey AS INT) AS num FROM region r CROSS JOIN nation n WHERE 1 + r.r_regionkey * 25 + n.n_nationkey <= 33
        UNION ALL SELECT 'P', CAST(1 + r.r_regionkey * 25 + n.n_nationkey AS INT) FROM region r CROSS JOIN nation n WHERE 1 + r.r_regionkey * 25 + n.n_nationkey <= 47
        UNION ALL SELECT 'H', CAST(1 + r.r_regionkey * 25 + n.n_nationkey AS INT) FROM region r CROSS JOIN nation n WHERE 1 + r.r_regionkey * 25 + n.n_nationkey <= 38""",
    "marks": """SELECT * FROM (SELECT form_id, bloque, num, concat(bloque, CAST(num AS STRING)) AS item,
        (form_id * 31 + num * 17 + (form_id % 97) * num + CASE bloque WHEN 'E' THEN 3 WHEN 'P' THEN 5 ELSE 7 END) % 12 AS code FROM forms CROSS JOIN item_dim) t WHERE code <> 11""",
    "marks_state": "SELECT form_id, item, bloque, num, CASE WHEN code < 4 THEN 'si' WHEN code < 9 THEN 'no' WHEN code = 9 THEN 'ambos' ELSE 'vacio' END AS opcion FROM marks",
    "marks_raw": "SELECT form_id, item, CASE WHEN num % 3 = 0 THEN concat(' ', upper(opcion), ' ') ELSE opcion END AS opcion FROM marks_state",
    "item_map": "SELECT concat('T', CAST(num % 7 AS STRING)) AS tipo, CAST(num % 7 AS INT) AS tipo_ord, bloque, num, concat(bloque, CAST(num AS STRING)) AS item FROM item_dim WHERE NOT (bloque = 'E' AND num % 7 = 6)",
    "types": "SELECT DISTINCT tipo, tipo_ord FROM item_map",
    "norms": """SELECT s.sexo, t.tipo, t.tipo_ord, CAST(p.pd AS BIGINT) AS pd, CAST(20 + 2 * t.tipo_ord + s.k + 3 * p.pd AS INT) AS baremo
        FROM (SELECT 'F' AS sexo, 0 AS k UNION ALL SELECT 'M', 2) s CROSS JOIN types t CROSS JOIN (SELECT n_nationkey AS pd FROM nation WHERE n_nationkey <= 9) p""",
    "careers": "SELECT CAST(dense_rank() OVER (ORDER BY p_name) AS INT) AS carrera_id, p_name AS carrera FROM (SELECT DISTINCT p_name FROM part) x",
    "career_types": "SELECT tipo, carrera, CAST(row_number() OVER (PARTITION BY tipo ORDER BY carrera) AS INT) AS ord FROM (SELECT carrera, concat('T', CAST(carrera_id % 7 AS STRING)) AS tipo FROM careers UNION SELECT carrera, concat('T', CAST((carrera_id * 3 + 1) % 7 AS STRING)) FROM careers) x",
    "career_groups": "SELECT carrera, split_part(carrera, ' ', 2) AS grupo FROM careers",
    "career_keywords": "SELECT carrera, split_part(carrera, ' ', 1) AS palabra FROM careers UNION SELECT carrera, split_part(carrera, ' ', 2) FROM careers UNION SELECT carrera, concat('k', CAST(carrera_id % 5 AS STRING)) FROM careers",
    "pair_rules": "SELECT a.carrera AS a, b.carrera AS b, concat('r', CAST(a.carrera_id AS STRING)) AS razon, a.carrera_id AS ord FROM careers a JOIN careers b ON b.carrera_id = a.carrera_id + 3 WHERE a.carrera_id % 4 = 0",
    "related_types": "SELECT concat('T', CAST(n_nationkey AS STRING)) AS tipo, concat('T', CAST((n_nationkey + 2) % 7 AS STRING)) AS rel FROM nation WHERE n_nationkey < 7 UNION ALL SELECT concat('T', CAST(n_nationkey AS STRING)), concat('T', CAST((n_nationkey + 3) % 7 AS STRING)) FROM nation WHERE n_nationkey < 7",
    "type_alias": "SELECT concat('T', CAST(n_nationkey AS STRING)) AS tipo, concat('T', CAST(n_nationkey + 10 AS STRING)) AS alias FROM nation WHERE n_nationkey < 2",
    "profiles": """SELECT carrera_id, carrera, 0.05D + (carrera_id * 7 % 19) / 20.0D AS r, 0.05D + (carrera_id * 11 % 19) / 20.0D AS i, 0.05D + (carrera_id * 13 % 19) / 20.0D AS a,
        0.05D + (carrera_id * 17 % 19) / 20.0D AS s, 0.05D + (carrera_id * 5 % 19) / 20.0D AS e, 0.05D + (carrera_id * 3 % 19) / 20.0D AS c FROM careers""",
    "texts": """SELECT c.c_custkey AS form_id, CASE c.c_custkey % 6 WHEN 0 THEN upper(k.carrera) WHEN 1 THEN concat('  ', k.carrera, '!') WHEN 2 THEN concat(split_part(k.carrera, ' ', 2), 's')
        WHEN 3 THEN substring(k.carrera, 1, length(k.carrera) - 1) WHEN 4 THEN concat('zz', CAST(c.c_custkey AS STRING)) ELSE '' END AS texto FROM customer c JOIN careers k ON k.carrera_id = 1 + c.c_custkey % 64""",
    "aliases": "SELECT concat('al', CAST(carrera_id AS STRING)) AS alias, carrera FROM careers UNION ALL SELECT split_part(carrera, ' ', 2), min(carrera) FROM careers GROUP BY split_part(carrera, ' ', 2)",
    "expansions": "SELECT split_part(carrera, ' ', 1) AS token, concat('k', CAST(carrera_id % 5 AS STRING)) AS expansion FROM careers",
    "institutions": "SELECT carrera, 'publica' AS institucion FROM careers WHERE carrera_id % 3 <> 0 UNION ALL SELECT carrera, 'privada' FROM careers WHERE carrera_id % 4 < 2",
    "level_lists": "SELECT carrera, CASE WHEN carrera_id % 9 = 0 THEN 'cetpro' ELSE 'tecnico' END AS nivel FROM careers WHERE carrera_id % 9 IN (0, 1, 2)",
    # A supplier's lines with one return flag fill the blocks of its forms, 47 each.
    "signals": """SELECT l_suppkey + 10000000 * CAST(floor((rn - 1) / 47) AS BIGINT) AS form_id, bloque, CAST(1 + (rn - 1) % 47 AS INT) AS num, dens_no, dens_si, dens_no * 0.9D AS centro_no, dens_si * 1.1D AS centro_si, sr AS stroke_no, 1.0D - sr / 2 AS stroke_si, dt AS dt_no, 0.5D - dt / 2 AS dt_si, sym_no, sym_si FROM (
        SELECT l_suppkey, l_returnflag AS bloque, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn,
        CAST(l_discount AS DOUBLE) * CASE l_suppkey % 4 WHEN 0 THEN 0.1D WHEN 1 THEN 0.4D WHEN 2 THEN 1.0D ELSE 2.5D END AS dens_no,
        CAST(l_tax AS DOUBLE) * CASE l_suppkey % 4 WHEN 0 THEN 0.1D WHEN 1 THEN 0.4D WHEN 2 THEN 1.0D ELSE 2.5D END AS dens_si,
        l_quantity / 50.0D AS sr, (l_partkey % 10) / 10.0D AS dt, (l_partkey % 5) / 4.0D AS sym_no, (l_orderkey % 5) / 4.0D AS sym_si FROM lineitem) t""",
    "run_log": "SELECT event_type AS stage, user_id AS worker, value AS seconds, ts FROM events",
    # Raw scores as E1 gives them, for the operators behind it.
    "scores": """SELECT f.form_id, f.sexo, t.tipo, t.tipo_ord, CAST(coalesce(s.pd, 0) AS BIGINT) AS pd FROM forms f CROSS JOIN types t LEFT JOIN
        (SELECT m.form_id, i.tipo, sum(CASE WHEN m.opcion IN ('si', 'ambos') THEN 1 ELSE 0 END) AS pd FROM marks_state m JOIN item_map i ON i.item = m.item GROUP BY m.form_id, i.tipo) s ON s.form_id = f.form_id AND s.tipo = t.tipo""",
    "normed": "SELECT s.form_id, s.sexo, s.tipo, s.tipo_ord, s.pd, n.baremo FROM scores s LEFT JOIN norms n ON n.sexo = s.sexo AND n.tipo = s.tipo AND n.pd = s.pd",
    "ranked": "SELECT *, CAST(row_number() OVER (PARTITION BY form_id ORDER BY coalesce(baremo, -1) DESC, pd DESC, tipo_ord) AS INT) AS posicion FROM normed",
    "tops": "SELECT form_id, max(CASE WHEN posicion = 1 THEN tipo END) AS tipo1, max(CASE WHEN posicion = 2 THEN tipo END) AS tipo2 FROM ranked GROUP BY form_id",
    # Every character of a document is a pixel; each 384 of them are a cell, 16 high and 24 wide, the last one as far as they reach.
    "pixels": """SELECT doc_id * 100000 + CAST(floor(p.pos / 384) AS BIGINT) AS cell_id, CAST(floor((p.pos % 384) / 24) AS INT) AS y, CAST(p.pos % 24 AS INT) AS x, CAST(CASE WHEN ascii(p.ch) % 5 = 0 THEN 1 ELSE 0 END AS INT) AS ink, CAST(ascii(p.ch) % 256 AS INT) AS gray
        FROM documents LATERAL VIEW posexplode(split(text, '')) p AS pos, ch WHERE length(text) > 0""",
    # The same cells, packed: a row for each, made from its piece of the text. Spark alone reads this one. The pieces are dealt
    # over as many tasks as the session's shuffles have, as a few large files would leave the work on cells to a few tasks.
    # Text is cut in one pass. INK translates the letters it knows at once; a piece with others is read letter by letter.
    "packed_cells": """SELECT cell_id, size(ink) AS h, CAST(least(24, length(ink[0])) AS INT) AS w, ink,
        transform(regexp_extract_all(piece, '(?s).{1,24}', 0), r -> transform(split(r, ''), ch -> CAST(ascii(ch) % 256 AS INT))) AS gray
        FROM (SELECT cell_id, piece, regexp_extract_all(CASE WHEN known RLIKE '^[01]*$' THEN known ELSE array_join(transform(split(piece, ''), ch -> IF(ascii(ch) % 5 = 0, '1', '0')), '') END, '.{1,24}', 0) AS ink
        FROM (SELECT cell_id, piece, translate(piece, INK) AS known FROM (SELECT /*+ REPARTITION(PARTS, cell_id) */ cell_id, piece
        FROM (SELECT doc_id * 100000 + e.k AS cell_id, e.piece FROM documents LATERAL VIEW posexplode(regexp_extract_all(text, '(?s).{1,384}', 0)) e AS k, piece WHERE length(text) > 0) x) y) z) a""",
    "files": """SELECT page_id, CASE page_id % 10 WHEN 0 THEN concat('bad', CAST(page_id AS STRING)) WHEN 1 THEN concat('ana-maria_soto_', CAST(11 + page_id % 9 AS STRING), '_f') WHEN 2 THEN concat('jose perez ', CAST(11 + page_id % 9 AS STRING), ' M')
        ELSE concat('luz-', CAST(page_id AS STRING), '-rios-', CAST(11 + page_id % 9 AS STRING), '-F') END AS nombre, CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.JPG' WHEN 2 THEN '.xyz' ELSE '' END AS ext,
        CASE page_id % 5 WHEN 0 THEN concat('%PDF-1.7', html) WHEN 1 THEN concat('BM', html) WHEN 2 THEN concat('RIFF0000WEBP', html) WHEN 3 THEN concat('II*', chr(0), html) ELSE html END AS content,
        CASE WHEN page_id % 2 = 0 THEN 'F' ELSE 'M' END AS sexo FROM pages""",
    "tokens": """SELECT doc_id AS image_id, p.pos + 1 AS pos, p.word AS text, CASE WHEN (doc_id + p.pos + 1) % 13 = 0 THEN 'x' WHEN (doc_id + p.pos + 1) % 11 = 0 THEN '-1' ELSE CAST((doc_id * 7 + (p.pos + 1) * 31) % 100 AS STRING) END AS conf,
        (p.pos + 1) * 17 AS "left", CAST(doc_id % 50 * 11 AS INT) AS top, 11 + p.pos AS width, CAST(12 AS INT) AS height FROM documents LATERAL VIEW posexplode(split(text, ' ')) p AS pos, word""",
    # The same tokens, packed: a row for each image, with lists in their order. Spark alone reads this one.
    "packed_tokens": """SELECT image_id, text, transform(text, (word, pos) -> CASE WHEN (image_id + pos + 1) % 13 = 0 THEN 'x' WHEN (image_id + pos + 1) % 11 = 0 THEN '-1' ELSE CAST((image_id * 7 + (pos + 1) * 31) % 100 AS STRING) END) AS conf
        FROM (SELECT doc_id AS image_id, split(text, ' ') AS text FROM documents WHERE text IS NOT NULL) d""",
    "proposals": "SELECT f.form_id, CAST(o.n_nationkey + 1 AS INT) AS ord, t.texto FROM forms f CROSS JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey < 3) o CROSS JOIN (SELECT count(*) AS n FROM customer) k JOIN texts t ON t.form_id = 1 + (f.form_id + CASE o.n_nationkey WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 31 END) % k.n",
    "prefs": "SELECT form_id, CASE form_id % 4 WHEN 0 THEN 'sin_especificar' WHEN 1 THEN 'universitario' WHEN 2 THEN 'tecnico' ELSE 'cetpro' END AS nivel_max, CASE form_id % 3 WHEN 0 THEN 'indiferente' WHEN 1 THEN 'publica' ELSE 'privada' END AS institucion FROM forms",
    "person_profiles": """SELECT form_id, 0.05D + (form_id * 7 % 23) / 24.0D AS r, 0.05D + (form_id * 11 % 23) / 24.0D AS i, 0.05D + (form_id * 13 % 23) / 24.0D AS a,
        0.05D + (form_id * 17 % 23) / 24.0D AS s, 0.05D + (form_id * 5 % 23) / 24.0D AS e, 0.05D + (form_id * 3 % 23) / 24.0D AS c FROM forms""",
    # Lines of a page: positions of lines of text, as cuts along an axis.
    # A supplier's lines are dealt to pages of 55 to 74 lines.
    "cuts": """SELECT page_id, CAST(sum(step) OVER (PARTITION BY page_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS pos FROM (SELECT l_suppkey + 10000000 * CAST(floor((rn - 1) / (55 + l_suppkey % 20)) AS BIGINT) AS page_id, rn, step
        FROM (SELECT l_suppkey, 1 + l_partkey % 40 AS step, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem) a) b""",
    # On every fourth page all boxes are low.
    "boxes": "SELECT l_suppkey AS page_id, l_orderkey * 10 + l_linenumber AS box_id, CAST(l_partkey % 900 AS INT) AS x, CAST(l_partkey % 7 AS INT) AS y, CAST(60 + l_orderkey % 700 AS INT) AS w, CAST(CASE WHEN l_suppkey % 4 = 1 THEN 20 + l_quantity ELSE 200 + l_quantity * 16 END AS INT) AS h FROM lineitem",
    "segments": "SELECT l_suppkey AS page_id, CAST(0 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, CAST(l_quantity - 25 AS DOUBLE) AS x2, CAST(l_partkey % 9 - 4 AS DOUBLE) AS y2 FROM lineitem",
}

# Exploding has no common spelling.
DUCK_VIEWS = {
    "pixels": """SELECT doc_id * 100000 + pos // 384 AS cell_id, CAST(pos % 384 // 24 AS INT) AS y, CAST(pos % 24 AS INT) AS x, CAST(CASE WHEN ascii(ch) % 5 = 0 THEN 1 ELSE 0 END AS INT) AS ink, CAST(ascii(ch) % 256 AS INT) AS gray
        FROM (SELECT doc_id, unnest(c) AS ch, unnest(range(len(c))) AS pos FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 0) a) b""",
    "tokens": """SELECT doc_id AS image_id, CAST(pos AS INT) AS pos, word AS text, CASE WHEN (doc_id + pos) % 13 = 0 THEN 'x' WHEN (doc_id + pos) % 11 = 0 THEN '-1' ELSE CAST((doc_id * 7 + pos * 31) % 100 AS STRING) END AS conf,
        CAST(pos * 17 AS INT) AS "left", CAST(doc_id % 50 * 11 AS INT) AS top, CAST(10 + pos AS INT) AS width, CAST(12 AS INT) AS height
        FROM (SELECT doc_id, unnest(c) AS word, unnest(range(1, len(c) + 1)) AS pos FROM (SELECT doc_id, string_split(text, ' ') AS c FROM documents) a) b""",
}

# The same rows for Spark, dealt over as many tasks as the session's shuffles have. A table of forms is a small file, of which a few tasks
# would make all answers, and a few items, types or numbers are what is broadcast: joined by their keys, all answers would meet in a task for each
# item, and all scores in one for each norm. And lines and cuts compress so well that tasks put together by their size would sort too many at once.
SPARK_VIEWS = {
    v: re.sub(r"FROM forms( f)? CROSS", r"FROM (SELECT /*+ REPARTITION(PARTS, form_id) */ * FROM forms)\1 CROSS", VIEWS[v].replace(f"SELECT {first}", f"SELECT /*+ BROADCAST({few}) */ {first}"))
    for v, first, few in (("marks", "form_id, bloque", "item_dim"), ("scores", "f.form_id, f.sexo", "t"), ("proposals", "f.form_id, CAST(o.", "o, k"))
} | {
    "normed": VIEWS["normed"].replace("SELECT s.form_id", "SELECT /*+ BROADCAST(n) */ s.form_id"),
    "cuts": VIEWS["cuts"]
    .replace("ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS pos FROM (SELECT l_suppkey +", "ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS pos FROM (SELECT /*+ REPARTITION(PARTS, page_id) */ * FROM (SELECT l_suppkey +")
    .replace("FROM lineitem) a) b", "FROM (SELECT /*+ REPARTITION(PARTS, l_suppkey) */ l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem) l) a) c) b"),
}

SPARK_VIEWS["scores"] = SPARK_VIEWS["scores"].replace("SELECT m.form_id", "SELECT /*+ BROADCAST(i) */ m.form_id")

# The letters up to U+024F, and a 1 for each that is ink, as arguments of translate.
_LETTERS = range(1, 0x250)
SPARK_VIEWS["packed_cells"] = VIEWS["packed_cells"].replace("INK", "'" + "".join(f"\\u{c:04x}" for c in _LETTERS) + "', '" + "".join("10"[c % 5 > 0] for c in _LETTERS) + "'")

_WORD = re.compile(r"[A-Za-z_]+")


def _needs(sql: str) -> list[str]:
    words = set(_WORD.findall(sql))
    return [v for v in VIEWS if v in words]


@lru_cache(maxsize=None)
def with_views(sql: str, files: frozenset[str] = frozenset()) -> tuple[str, ...]:
    """The views that `sql` needs, each after those that it needs itself. Views in `files` need nothing."""
    out: list[str] = []

    def add(name: str, above: tuple[str, ...]) -> None:
        for other in () if name in files else _needs(VIEWS[name]):
            if other != name and other not in above and other not in out:
                add(other, (*above, name))
        if name not in out:
            out.append(name)

    for name in _needs(sql):
        add(name, ())
    return tuple(out)


def duck(sql: str) -> str:
    """`sql` for DuckDB, with the views that it names as common table expressions."""
    text = lambda s: re.sub(r"\b(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", s)
    heads = [f"{v} AS ({text(DUCK_VIEWS.get(v, VIEWS[v]))})" for v in with_views(sql)]
    body = text(sql).strip()
    if body[:5].upper() == "WITH ":
        heads.append(body[5:])
        return "WITH RECURSIVE " + ", ".join(heads)
    return (f"WITH {', '.join(heads)} " if heads else "") + body


def view(spark: SparkSession, sf_dir: str, name: str, files: dict[str, str] | None = None) -> DataFrame:
    """A view, or a table, as a DataFrame over the files of a data folder. files: views that are written already, and where."""
    files = files or {}
    if name in TABLES or name in files:
        return spark.read.parquet(files.get(name, f"{sf_dir}/{name}.parquet"))
    names = with_views(f"SELECT * FROM {name}", frozenset(files))
    words = {w for v in names if v not in files for w in _WORD.findall(VIEWS[v])}
    heads = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if t in words]
    heads += [f"{v} AS (SELECT * FROM parquet.`{files[v]}`)" if v in files else f"{v} AS ({SPARK_VIEWS.get(v, VIEWS[v]).replace('"left"', '`left`')})" for v in names]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    return spark.sql(f"WITH {', '.join(heads)} SELECT * FROM {name}".replace("REPARTITION(PARTS,", f"REPARTITION({parts},"))
