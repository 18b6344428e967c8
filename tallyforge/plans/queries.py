"""One registered query for each operator of the questionnaire engine, over the views of fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import affinity, classify, layout, marks, monitor, proposal, recommend, scoring
from ..sources import ingest
from ..sources.storage import settle, shared_path
from .fixtures import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TYPES = [f"T{i}" for i in range(7)]
BLOCKS = {"A": 12, "N": 40, "R": 47}


class Views:
    """The views of a data folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.done, self.kept = spark, sf_dir, {}, {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.kept)

    def keep(self, *names: str) -> None:
        """Write these views, in this order; all views that follow read the files."""
        for name in names:
            if name not in self.kept:
                path = shared_path(self.spark, name)
                getattr(self, name).write.parquet(path)
                self.kept[name] = path


def query(fn: Callable[[Views], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
    return fn


def once(fn):
    """Written at its first use in a query and read by all that follow."""

    def settled(v: Views, *args):
        key = (fn.__name__, *args)
        if key not in v.done:
            v.done[key] = settle(fn(v, *args), fn.__name__.strip("_"))
        return v.done[key]

    return settled


def joined(*cols: str):
    """Array columns as text, which every engine compares alike."""
    return {c: F.array_join(c, ",") for c in cols}


def linked(df: DataFrame, careers: DataFrame, number, how: str = "inner") -> DataFrame:
    """Rows with the catalogue entry that `number` gives."""
    return df.withColumn("carrera_id", number.cast("int")).join(careers, "carrera_id", how).drop("carrera_id")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, kind in df.dtypes if kind == "double"})


# ---- sources and sinks


@query
def a1_scan_files(v):
    return ingest.scan_files(v.spark, v.sf_dir, "*.parquet").select("name", "length")


@query
def a2_sniff_type(v):
    return ingest.sniff_type(v.files.withColumn("path", F.concat("nombre", "ext")), "path", "content").select("page_id", "tipo")


def _parsed(v):
    return ingest.parse_form_name(v.files.select("page_id", F.concat("nombre", F.lit(".pdf")).alias("name")))


@query
def a3_parse_form_name(v):
    return _parsed(v).select("page_id", "valid", "nombre", "edad", "sexo")


@query
def a4_split_valid(v):
    good, bad = ingest.split_valid(_parsed(v))
    every, none = ingest.split_valid(_parsed(v), "batch")
    of = lambda df, s: df.select("page_id", F.lit(s).alias("destino"))
    return of(good, "skip:aceptado").unionByName(of(bad, "skip:rechazado")).unionByName(of(every, "batch:aceptado")).unionByName(of(none, "batch:rechazado"))


def _work(v):
    return v.files.select(F.col("page_id").alias("file_id"), "content", "sexo").unionByName(v.files.where("page_id % 50 = 0").select((F.col("page_id") + 1000000).alias("file_id"), "content", "sexo"))


def _cache(v):
    return v.files.where("page_id % 3 = 0").select(ingest.cache_key().alias("cache_key"), F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("resultado"))


@query
def a5_with_cached(v):
    return ingest.with_cached(_work(v), _cache(v)).select("file_id", "cache_key", "cached", "resultado")


@query
def a5_distinct_work(v):
    return ingest.distinct_work(_work(v), _cache(v)).select("cache_key")


def measure(row: dict) -> dict:
    """The length of a file; archives of one kind can't be read."""
    if row["content"].startswith("RIFF"):
        raise ValueError("not readable")
    return {"n": len(row["content"])}


@query
def a5_process_cached(v):
    """Two batches: all files, then all files and a longer version of each. The second finds what the first has stored."""
    store = shared_path(v.spark, "cache")
    first = v.files.select(F.col("page_id").alias("file_id"), F.lit(1).alias("version"), "content", "sexo")
    ingest.process_cached(first, measure, "n int", store, "1").count()
    both = first.unionByName(first.select("file_id", F.lit(2).alias("version"), F.concat("content", F.lit("+")).alias("content"), "sexo"))
    return ingest.process_cached(both, measure, "n int", store, "2").select("file_id", "version", "cache_key", "cached", "n", "ok", "error")


@query
def a6_cache_stats(v):
    return ingest.cache_stats(v.files.select(F.octet_length("content").alias("length")))


def parse_or_fail(row: dict) -> dict:
    """The age that a name holds; names without one fail."""
    import re

    found = re.match(ingest.NAME_PATTERN, row["nombre"])
    if not found:
        raise ValueError(f"bad name: {row['nombre']}")
    return {"page_id": row["page_id"], "edad": int(found[2])}


@query
def a7_run_batch(v):
    return ingest.run_batch(v.files.select("page_id", "nombre"), parse_or_fail, "page_id long, edad int").withColumn("edad", F.when(F.col("ok"), F.col("edad")))


def _written(v, doc: DataFrame, tag: str) -> str:
    """The path of a JSON file that holds the only value of `doc`: a catalogue is one document."""
    path = shared_path(v.spark, tag)
    doc.write.text(path)
    return path


def _affinity_file(v):
    """The flat catalogue as a nested JSON file."""
    lists = v.career_types.groupBy("tipo").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "carrera"))), lambda s: s["carrera"]).alias("l"))
    carreras = lists.agg(F.map_from_entries(F.collect_list(F.struct("tipo", "l"))).alias("carreras"))
    words = v.career_keywords.groupBy("carrera").agg(F.collect_list("palabra").alias("l")).agg(F.map_from_entries(F.collect_list(F.struct("carrera", "l"))).alias("palabras_clave"))
    rules = v.pair_rules.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "a", "b", "razon"))), lambda r: F.struct(F.array(r["a"], r["b"]).alias("carreras"), r["razon"].alias("razon"))).alias("reglas"))
    one = carreras.crossJoin(words).crossJoin(rules)  # a row each
    return _written(v, one.select(F.to_json(F.struct("*", F.struct(F.lit(4).alias("peso_grupo")).alias("config"))).alias("j")), "affinity")


@query
def a8_load_affinity(v):
    flat = ingest.load_affinity(v.spark, _affinity_file(v))
    out = flat["types"].select(F.lit("types").alias("tabla"), F.col("tipo").alias("x"), F.col("carrera").alias("y"), F.col("ord").cast("string").alias("z"))
    out = out.unionByName(flat["keywords"].select(F.lit("keywords").alias("tabla"), F.col("carrera").alias("x"), F.col("palabra").alias("y"), F.lit("").alias("z")))
    out = out.unionByName(flat["rules"].select(F.lit("rules").alias("tabla"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("razon").alias("z")))
    return out.unionByName(flat["weights"].select(F.lit("weights").alias("tabla"), F.col("peso_regla_especial").cast("string").alias("x"), F.col("peso_grupo").cast("string").alias("y"), F.col("peso_palabra_clave").cast("string").alias("z")))


def _catalog_file(v):
    """The semantic catalogue as a JSON file: level and institution as a list, a single value or left out, profiles and aliases left out here and there."""
    level = F.when(F.col("carrera_id") % 3 == 0, F.lit('["universitario","tecnico"]')).when(F.col("carrera_id") % 3 == 1, F.lit('"universitario"'))
    place = F.when(F.col("carrera_id") % 2 == 0, F.lit('"publica"')).otherwise(F.lit('["publica","privada"]'))
    words = F.array(F.split_part("carrera", F.lit(" "), F.lit(1)), F.split_part("carrera", F.lit(" "), F.lit(2)), F.concat(F.lit("k"), (F.col("carrera_id") % 5).cast("string")))
    rest = F.to_json(F.struct(
        F.col("carrera").alias("nombre"), F.lit("area").alias("area"), words.alias("keywords"),
        F.when(F.col("carrera_id") % 11 != 0, F.array("r", "i", "a", "s", "e", "c")).alias("perfil_riasec"),
        F.when(F.col("carrera_id") % 4 == 0, F.array(F.concat(F.lit("al"), F.col("carrera_id").cast("string")))).alias("alias"),
    ))
    entry = F.concat(F.lit('{"institucion":'), place, F.coalesce(F.concat(F.lit(',"nivel":'), level), F.lit("")), F.lit(","), F.substr(rest, F.lit(2)))
    listed = v.profiles.select("carrera_id", entry.alias("e")).agg(F.array_sort(F.collect_list(F.struct("carrera_id", "e"))).alias("l"))
    return _written(v, listed.select(F.concat(F.lit('{"carreras":['), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]}"))), "catalog")


@once
def _catalog(v) -> DataFrame:
    """The semantic catalogue: ord, carrera, nivel, institucion, the six letters, alias, keywords."""
    c = ingest.load_catalog(v.spark, _catalog_file(v))
    return c.select("ord", F.col("nombre").alias("carrera"), "nivel", "institucion", *[F.col("perfil")[i].alias(x) for i, x in enumerate(recommend.LETTERS)], "keywords", "alias")


@query
def a9_load_catalog(v):
    return rounded(_catalog(v).withColumns(joined("nivel", "institucion", "keywords", "alias")))


@query
def a10_with_batch_fields(v):
    df = v.forms.withColumn("d", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("form_id") % 300).cast("int")))
    return ingest.with_batch_fields(df, "d", ie="Colegio", grado="5", nivel="COMPLETA").select("form_id", "ie", "grado", "nivel", "fecha")


def _best_pairs(v):
    v.keep("careers")
    return affinity.best_two_pairs(_leading_pairs(v))


@once
def _suggested(v):
    v.keep("tops")
    return affinity.suggest(v.tops, _best_pairs(v))


def _rows(tables: dict[str, DataFrame], key: str = "form_id") -> DataFrame:
    """Every row of every table, as tabla, the key and the other columns as one text."""
    out = None
    for name, df in tables.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns if c != key])
        part = df.select(F.lit(name).alias("tabla"), F.col(key).cast("long").alias(key), text.alias("fila"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def a11_write_evaluation(v):
    tables = ingest.evaluation_tables(v.forms, v.marks_state, v.ranked, _suggested(v))
    dest = shared_path(v.spark, "evaluation")
    for _ in range(2):  # the second time replaces the first
        ingest.write_evaluation(tables, dest, "1")
    return _rows({name: df.drop("lote", "grupo") for name, df in ingest.read_evaluation(v.spark, dest).items()})


@query
def a11_write_evaluation_deleted(v):
    """Two stored batches, and the forms divisible by 7 deleted from both."""
    tables = ingest.evaluation_tables(v.forms, v.marks_state, v.ranked, _suggested(v))
    again = {name: df.withColumn("form_id", -F.col("form_id") - 1) for name, df in tables.items()}
    dest = shared_path(v.spark, "evaluation")
    for batch, part in (("1", tables), ("2", again)):
        ingest.write_evaluation(part, dest, batch)
    ingest.delete_stored(v.spark, dest, v.forms.where("form_id % 7 = 0").select(F.explode(F.array("form_id", -F.col("form_id") - 1)).alias("form_id")))
    return _rows({name: df.drop("lote", "grupo") for name, df in ingest.read_evaluation(v.spark, dest).items()})


@query
def a12_check_evaluation(v):
    bad_marks = v.marks_state.select("form_id", F.when(F.col("num") % 40 != 0, F.col("item")).alias("item")).unionByName(v.marks_state.where("num = 3 AND form_id % 5 = 0").select((F.col("form_id") - F.when(F.col("form_id") % 2 == 0, 0).otherwise(1000000)).alias("form_id"), "item"))
    bad_forms = v.forms.withColumn("sexo", F.when(F.col("form_id") % 9 == 0, F.lit("X")).otherwise(F.col("sexo")))
    return ingest.check_evaluation(bad_forms, bad_marks, v.ranked.select("form_id", "tipo").unionByName(v.ranked.where("posicion = 1 AND form_id % 4 = 0").select("form_id", "tipo")))


@query
def a13_latest(v):
    return ingest.latest(v.orders.select(F.col("o_orderkey").alias("form_id"), F.col("o_orderdate").alias("fecha_procesado")), 20)


@query
def a14_consolidated(v):
    return ingest.consolidated(v.forms, scoring.with_level(v.normed), v.proposals, TYPES)


@query
def a15_export(v):
    path = shared_path(v.spark, "export")
    ingest.export(a14_consolidated(v), path)
    return v.spark.read.csv(path, header=True)


@query
def a16_delete_forms(v):
    scores = v.normed.select("form_id", "tipo", "pd", "baremo")
    return _rows(ingest.delete_forms({"formulario": v.forms.select("form_id", "nombre", "sexo"), "marca": v.marks_state.select("form_id", "item", "opcion"), "resultado": scores}, v.forms.where("form_id % 7 = 0")))


# ---- items, marks, validation


@query
def b1_item_dim(v):
    """Blocks as long as in the item table."""
    sizes = {r["bloque"]: r["n"] for r in v.item_dim.groupBy("bloque").agg(F.max("num").alias("n")).collect()}  # three rows
    return marks.item_dim(v.spark, sizes)


def _items(v):
    return marks.item_dim(v.spark)


@query
def b2_complete_marks(v):
    return marks.complete_marks(v.marks_state, v.forms, _items(v))


@query
def b3_mark_points(v):
    return marks.mark_points(v.marks_raw)


@query
def b4_binarize_marks(v):
    return marks.binarize_marks(v.marks_raw).select("form_id", "item", "opcion")


@query
def b5_audit_marks(v):
    return marks.audit_marks(v.marks_raw).withColumns(joined("vacios", "ambos", "dudosos"))


def _labels(v):
    damaged = F.when(F.col("num") % 5 == 0, F.concat(F.lit(" "), F.lower("item"), F.lit(" "))).when(F.col("num") % 5 == 1, F.concat(F.col("num").cast("string"), F.col("bloque"))).when(F.col("num") % 5 == 2, F.translate("item", "1", "I")).when(F.col("num") % 7 == 3, F.concat("item", F.lit("9"))).otherwise(F.translate("item", "1", "l"))
    return v.marks_state.select("form_id", "num", damaged.alias("label"))


@query
def b6_repair_labels(v):
    return marks.repair_labels(_labels(v)).select("form_id", "label", "item")


@query
def b7_validate_labels(v):
    return marks.validate_labels(marks.repair_labels(_labels(v)), _items(v)).groupBy("item", "valid").agg(F.count(F.lit(1)).alias("n"))


def _names(v):
    name = F.when(F.col("form_id") % 6 == 0, "").when(F.col("form_id") % 6 == 1, "Q").when(F.col("form_id") % 6 == 2, F.repeat(F.lit("ab"), 30)).when(F.col("form_id") % 6 == 3, F.col("nombre")).when(F.col("form_id") % 6 == 4, "  María-José d'Alba ").otherwise("Ana--Luz")
    return v.forms.select("form_id", name.alias("nombres"), F.when(F.col("form_id") % 2 == 0, "Ñuñez Peña").otherwise("R0jas!").alias("apellidos"))


@query
def b8_validate_names(v):
    return marks.validate_names(_names(v), ["nombres", "apellidos"])


@query
def b9_sanitize_names(v):
    return marks.sanitize_names(_names(v), ["nombres", "apellidos"])


@query
def b10_full_name(v):
    return marks.full_name(_names(v), ["nombres", "apellidos"]).select("form_id", "nombre_completo", "inicial")


@query
def b11_find_tokens(v):
    exact = marks.find_tokens(v.tokens, "the").withColumn("modo", F.lit("exacto"))
    return exact.unionByName(marks.find_tokens(v.tokens, "en", False).withColumn("modo", F.lit("contiene")))


@query
def b12_token_summary(v):
    return marks.token_summary(v.packed_tokens)


def _classified(v):
    return classify.classify_forms(v.signals)


@query
def b13_doubtful_items(v):
    c = v.signals.select("form_id", F.concat("bloque", F.col("num").cast("string")).alias("item"), F.when(F.col("num") % 4 == 0, "ambos").otherwise("si").alias("opcion"), ((F.col("form_id") % 3 == 0) & (F.col("num") % 10 == 0)).alias("revisar"), F.when(F.col("form_id") % 3 == 1, F.col("stroke_no")).alias("confianza"), (F.col("form_id") % 2 == 0).alias("exito"))
    return marks.doubtful_items(c)


@query
def b14_form_summary(v):
    return marks.form_summary(v.marks_raw)


@query
def b14_score_view(v):
    return marks.score_view(v.normed)


# ---- ink and layout


@query
def c1_ink_features(v):
    return rounded(layout.ink_features(v.packed_cells), 9)


@query
def c2_half_density(v):
    return rounded(layout.half_density(v.packed_cells), 9)


@query
def c3_quadrant_symmetry(v):
    blank = F.transform("ink", lambda r, y: F.when((y < 8) & (F.col("cell_id") % 2 == 0), F.replace(r, F.lit("1"), F.lit("0"))).otherwise(r))
    return layout.quadrant_symmetry(v.packed_cells.withColumn("ink", blank))


@query
def c4_gray_variance(v):
    return layout.gray_variance(v.packed_cells)


@query
def c5_border_dark_share(v):
    return rounded(layout.border_dark_share(v.packed_cells, least_side=10), 9)


@query
def c6_quality_gate(v):
    return layout.quality_gate(v.signals.select("form_id", "bloque", "num", F.col("dens_no").alias("ink_otsu"), (F.col("dens_si") * 4).alias("ink_adaptativo"), (F.col("stroke_no") * 400).alias("nitidez"))).select("form_id", "bloque", "num", "metodo", "motivo")


@query
def c7_diff_gate(v):
    s = v.signals.select("form_id", "bloque", "num", F.lit(100).alias("h"), F.lit(80).alias("w"), F.when(F.col("num") % 6 == 0, 99).otherwise(100).alias("diff_h"), F.lit(80).alias("diff_w"), F.col("dens_no").alias("diff_ink"))
    return layout.diff_gate(s).select("form_id", "bloque", "num", "modo")


@query
def c8_profile_peaks(v):
    return layout.profile_peaks(v.pixels, "y", 0.6)


PAGE = ["page_id"]


@query
def c9_cluster_coords(v):
    return layout.cluster_coords(v.cuts, 12, PAGE).select("page_id", "pos")


@query
def c10_cuts_to_intervals(v):
    return layout.cuts_to_intervals(v.cuts.distinct(), PAGE)


def _page_pixels(v):
    """Pixels of pages of up to 50 cells, one above the other: a document has as many pages as it needs."""
    return v.pixels.select(F.floor(F.col("cell_id") / 50).alias("page_id"), (F.col("cell_id") % 50 * 16 + F.col("y")).cast("int").alias("y"), "x", "ink")


@once
def _line_rows(v):
    """The rows of these pages, straight from the cells: a string of ink each."""
    rows = v.packed_cells.select(F.floor(F.col("cell_id") / 50).alias("page_id"), (F.col("cell_id") % 50 * 16).cast("int").alias("top"), F.posexplode("ink").alias("at", "ink"))
    return rows.select("page_id", (F.col("top") + F.col("at")).alias("y"), F.lit(24).alias("w"), "ink")


@once
def _line_cuts(v):
    """Cuts down the whole height of every page, at uneven distances that repeat every 98 rows."""
    parts = _line_rows(v).select("page_id", F.floor(F.col("y") / 98).cast("int").alias("part")).distinct()
    return parts.select("page_id", F.explode(F.array(*[F.col("part") * 98 + x for x in (0, 8, 16, 24, 48, 56, 90)])).alias("pos"))


@query
def c11_insert_missing_cuts(v):
    return layout.insert_missing_cuts(_line_cuts(v), _line_rows(v), PAGE)


def _intervals(v):
    return layout.cuts_to_intervals(layout.cluster_coords(v.cuts, 12, PAGE), PAGE)


@query
def c12_fit_rows(v):
    return layout.fit_rows(_intervals(v), 40, PAGE)


@query
def c13_uniform_grid(v):
    return layout.uniform_grid(v.supplier.select(F.col("s_suppkey").alias("page_id"), (F.col("s_suppkey") * 37 % 2000).cast("int").alias("h")), 33, PAGE)


@query
def c14_best_cut_pair(v):
    return layout.best_cut_pair(v.cuts.distinct(), v.cuts.select("page_id").distinct().withColumn("w", (200 + F.col("page_id") * 53 % 900).cast("int")), PAGE)


@query
def c15_filter_boxes(v):
    return layout.filter_boxes(v.boxes, 1000, 1000, PAGE)


@query
def c16_assign_items(v):
    rows = _intervals(v).withColumn("tabla", (1 + F.col("y1") % 3).cast("int")).withColumn("y2", F.when(F.col("fila") % 9 == 0, F.col("y1") + 2).otherwise(F.col("y2")))
    return layout.assign_items(rows, {"E": 33, "P": 47, "H": 38}, PAGE).select("page_id", "item", "y1", "y2")


@query
def c17_pixels_to_cells(v):
    px = _page_pixels(v)
    heights = px.groupBy("page_id").agg(F.max("y").alias("top"))
    cells = heights.select("page_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("top") / 10).cast("int"))).alias("cell")).select("page_id", "cell", (F.col("cell") * 10).alias("y1"), (F.col("cell") * 10 + 7).alias("y2"), F.lit(4).alias("x1"), F.lit(19).alias("x2"))
    return layout.pixels_to_cells(px, cells, PAGE).groupBy("page_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("ink").alias("tinta"), F.max("cy").alias("cy"), F.max("cx").alias("cx"))


@query
def c18_skew_angle(v):
    return rounded(layout.skew_angle(v.segments, PAGE))


# ---- classification


@query
def d1_cell_marked(v):
    s = v.signals.select("form_id", "bloque", "num", F.col("dens_no").alias("dens_total"), (F.col("stroke_no") * 60).alias("area_max"), (400 + F.col("num") * 60).alias("n_pixels"))
    return classify.cell_marked(s).select("form_id", "bloque", "num", "marcada")


@query
def d2_classify_simple(v):
    s = v.signals.withColumn("marca_no", F.col("dens_no") >= 0.02).withColumn("marca_si", F.col("dens_si") >= 0.02)
    return classify.classify_simple(s).select("form_id", "bloque", "num", "opcion", "puntaje", "confianza")


@query
def d3_block_regime(v):
    return rounded(classify.block_regime(v.signals), 9)


@query
def d4_residual_blocks(v):
    return rounded(classify.residual_blocks(v.signals), 9)


def _with_block(v):
    b = classify.block_regime(v.signals).select("form_id", "bloque", "umbral", F.col("p50").alias("mediana"))
    return v.signals.join(b, ["form_id", "bloque"])


@query
def d5_is_real_mark(v):
    return classify.is_real_mark(_with_block(v), "dens_no", "centro_no", "stroke_no").select("form_id", "bloque", "num", "real")


@query
def d6_classify_vote(v):
    return classify.classify_vote(_with_block(v)).select("form_id", "bloque", "num", "opcion", "puntaje", "confianza", "revisar", "motivo")


def _flag(name):
    return lambda v: classify.flag(v.signals, name).select("form_id", "bloque", "num", name)


for _id, _name in (("d7", "low_stroke"), ("d8", "neighbors"), ("d9", "inversion"), ("d10", "incoherent"), ("d11", "swap")):
    _fn = _flag(_name)
    _fn.__name__ = f"{_id}_flag_{_name}"
    query(_fn)


def _reviewed(v):
    return classify.merge_review(classify.with_flags(classify.classify_vote(_with_block(v)))).withColumn("item", F.concat("bloque", F.col("num").cast("string")))


@query
def d12_merge_review(v):
    return _reviewed(v).select("form_id", "item", "revisar", "motivo")


@query
def d12_review_list(v):
    return classify.review_list(_reviewed(v)).withColumns(joined("items_revisar"))


@query
def d13_classify_forms(v):
    return _classified(v).select("form_id", "item", "opcion", "puntaje", "confianza", "revisar", "motivo")


@query
def d14_form_outcome(v):
    problems = v.signals.where("form_id % 4 = 0").select("form_id").distinct().withColumn("n_problemas", F.lit(1))
    return classify.form_outcome(_classified(v), problems)


# ---- scoring


@query
def e1_raw_scores(v):
    return scoring.raw_scores(v.marks_raw, v.item_map, v.forms).drop("tipo_ord")


@query
def e2_norm_scores(v):
    odd = v.scores.withColumn("sexo", F.when(F.col("form_id") % 10 == 0, F.lit("?")).otherwise(F.col("sexo")))
    return scoring.norm_scores(odd.select("form_id", "sexo", "tipo", "pd"), v.norms)


@query
def e3_level(v):
    return scoring.with_level(v.normed).select("form_id", "tipo", "baremo", "nivel")


def _ranges(v):
    rows = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(n).alias("nivel"), F.lit(a).alias("desde"), F.lit(b).alias("hasta")) for o, n, a, b in ((1, "bajo", 0, 5), (2, "medio", 6, 9), (3, "alto", 9, 12))]))
    return v.norms.where("tipo_ord < 6").select("sexo", "tipo").distinct().select("sexo", "tipo", rows.alias("r")).select("sexo", "tipo", "r.*")


@query
def e4_level_by_range(v):
    return scoring.level_by_range(v.scores, _ranges(v)).select("form_id", "tipo", "pd", "nivel")


@query
def e5_rank_types(v):
    return scoring.rank_types(v.normed).select("form_id", "tipo", "pd", "baremo", "posicion")


@query
def e6_top_types(v):
    return scoring.top_types(v.ranked)


@query
def e7_type_key(v):
    spelled = v.part.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("Técnico ")).when(F.col("p_partkey") % 3 == 1, F.lit("ARTÍSTICO ")).otherwise(F.lit("")), F.when(F.col("p_partkey") % 3 == 2, F.lit("Investigativo")).otherwise(F.col("p_brand"))).alias("tipo"))
    return scoring.type_key(spelled)


def _leveled(v):
    return scoring.with_level(v.normed)


@query
def e8_potential(v):
    a = scoring.potential(_leveled(v), "enterprise", "T5", "T0").withColumn("modo", F.lit("enterprise"))
    return a.unionByName(scoring.potential(_leveled(v), "both", "T5", "T0").withColumn("modo", F.lit("both")))


@query
def e9_criteria_rollup(v):
    criteria = v.types.select((F.lit("C").cast("string")).alias("c"), "tipo", "tipo_ord").select(F.concat("c", (F.col("tipo_ord") % 3).cast("string")).alias("criterio"), (F.col("tipo_ord") % 3).alias("crit_ord"), "tipo")
    return scoring.criteria_rollup(v.normed, criteria).withColumns(joined("tipos"))


@query
def e10_profile_from_items(v):
    areas = v.item_map.where("tipo_ord < 5").select(F.concat(F.lit("A"), F.col("tipo_ord").cast("string")).alias("area"), "item").unionByName(v.region.where("r_regionkey = 0").select(F.lit("A9").alias("area"), F.lit(None).cast("string").alias("item")))
    return rounded(scoring.profile_from_items(v.marks_state, areas))


def _letters(v):
    return v.types.where("tipo_ord < 6").select("tipo", F.element_at(F.array(*[F.lit(x) for x in "riaser"]), F.col("tipo_ord") + 1).alias("letra"))


@query
def e11_profile_from_norms(v):
    return rounded(scoring.profile_from_norms(v.normed, _letters(v)))


@query
def e12_level_counts(v):
    return scoring.level_counts(_leveled(v))


@query
def e13_relative_level(v):
    return scoring.relative_level(v.scores).select("form_id", "tipo", "relativo")


@query
def e14_diff_vs_reference(v):
    a = scoring.diff_vs_reference(v.normed).withColumn("ref", F.lit("first"))
    return a.unionByName(scoring.diff_vs_reference(v.normed, "max").withColumn("ref", F.lit("max")))


@query
def e15_predominant(v):
    return scoring.predominant(v.normed)


@query
def e16_manual_order(v):
    order = v.types.where("tipo_ord <> 3").select("tipo", ((F.col("tipo_ord") * 5) % 7).alias("manual"))
    return scoring.manual_order(v.normed, order).select("form_id", "tipo", "lugar")


def _quick(v):
    return scoring.quick_report(_leveled(v), v.career_types, "T5", "T0")


@query
def e17_quick_report(v):
    return _quick(v).withColumns(joined("carreras_top"))


@query
def e18_level_grid(v):
    return scoring.level_grid(_leveled(v), TYPES)


@query
def e19_report_record(v):
    f = v.forms.withColumn("grado", F.when(F.col("form_id") % 3 == 0, "5").when(F.col("form_id") % 3 == 1, "4°").otherwise(" "))
    return scoring.report_record(f, _quick(v))


@query
def e20_plot_series(v):
    return scoring.plot_series(v.normed)


@query
def e21_score_forms(v):
    return scoring.score_forms(v.marks_raw, v.forms, v.item_map, v.norms, "T5", "T0")


# ---- affinity


@query
def f1_career_index(v):
    a = affinity.career_index(v.career_types, v.type_alias, False).withColumn("modo", F.lit("compat"))
    return a.unionByName(affinity.career_index(v.career_types, v.type_alias).withColumn("modo", F.lit("unico")))


@query
def f2_symmetric_rules(v):
    return affinity.symmetric_rules(v.pair_rules.unionByName(v.pair_rules.where("ord % 8 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("later").alias("razon"), (F.col("ord") + 100).alias("ord"))))


@once
def _sets(v):
    return affinity.career_sets(v.careers, v.career_groups, v.career_keywords)


@once
def _scored_pairs(v):
    return affinity.pair_affinity(affinity.type_pairs(v.career_types), _sets(v), affinity.symmetric_rules(v.pair_rules), v.related_types)


@once
def _leading_pairs(v):
    rules = affinity.symmetric_rules(v.pair_rules)
    return affinity.pair_affinity(affinity.leading_pairs(v.career_types, _sets(v), rules), _sets(v), rules, v.related_types)


@query
def f3_pair_affinity(v):
    return _scored_pairs(v).select("tipo_a", "tipo_b", "a", "b", "puntaje", "relacion")


@query
def f4_type_pairs(v):
    return affinity.type_pairs(v.career_types).select("tipo_a", "tipo_b", "a", "b")


@query
def f5_best_two_pairs(v):
    return affinity.best_two_pairs(_leading_pairs(v))


@query
def f6_suggest(v):
    return _suggested(v)


@query
def f7_normalize_text(v):
    raw = v.texts.select("form_id", F.concat("texto", F.lit("  Ñandú-É# Ő ř ǎ Š "), F.col("form_id").cast("string")).alias("texto"))
    return raw.select("form_id", T.normalize("texto").alias("map"), T.normalize("texto", "strip").alias("strip"))


def _pairs(v):
    c = v.careers
    return c.select(F.col("carrera").alias("a"), "carrera_id").join(c.select(F.col("carrera").alias("b"), ((F.col("carrera_id") * 5) % 61).alias("carrera_id")), "carrera_id").select("a", "b")


@query
def f8_best_affinity(v):
    return affinity.best_affinity(_pairs(v), affinity.career_index(v.career_types), _sets(v), affinity.symmetric_rules(v.pair_rules), v.related_types)


@query
def f9_verdict(v):
    return _scored_pairs(v).select("tipo_a", "tipo_b", "a", "b", affinity.verdict().alias("veredicto"))


@once
def _resolved(v, fuzzy=True):
    v.keep("careers", "texts")
    return affinity.resolve_names(v.texts, v.careers, v.aliases, v.career_keywords, fuzzy)


@query
def f10_resolve_names(v):
    return _resolved(v, False)


@query
def f10_resolve_names_fuzzy(v):
    return _resolved(v)


@query
def f11_analyze_written(v):
    return affinity.analyze_written(v.proposals, _suggested(v).select("form_id", "carrera"), _resolved(v), affinity.career_index(v.career_types), _sets(v), affinity.symmetric_rules(v.pair_rules), v.related_types)


@query
def f12_closest_name(v):
    return _named(v)


@once
def _named(v):
    v.keep("careers", "texts")
    return affinity.closest_name(v.texts, v.careers)


@query
def f13_similarity(v):
    t = linked(v.texts, v.careers, 1 + F.col("form_id") % 60).select("form_id", F.lower("texto").alias("x"), "carrera")
    return t.select("form_id", F.round(T.ratio("x", "carrera"), 6).alias("bloques"), F.round(T.edit_ratio("x", "carrera"), 6).alias("edicion"))


@query
def f13_edit_ratio(v):
    t = linked(v.texts, v.careers, 1 + F.col("form_id") % 60).select("form_id", F.lower("texto").alias("x"), "carrera")
    return t.select("form_id", F.round(T.edit_ratio("x", "carrera"), 6).alias("edicion"))


# ---- recommendation


def _index(v):
    return recommend.search_index(_catalog(v))


@query
def g1_search_index(v):
    i = _index(v)
    rows = [i[k].select(F.lit(k).alias("indice"), F.col(c).alias("clave"), "ord") for k, c in (("alias", "alias"), ("phrase", "frase"), ("token", "token"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def g2_stem(v):
    words = v.documents.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''").distinct()
    return words.select("w", T.stem("w").alias("raiz"))


@query
def g3_expand_tokens(v):
    words = v.texts.select(T.normalize("texto").alias("q")).distinct().select("q", F.explode(F.split("q", " ")).alias("token")).where(F.length("token") >= 3)
    return recommend.expand_tokens(words, v.expansions)


@once
def _matches(v, fuzzy=True):
    v.keep("careers", "texts")
    return recommend.search(v.texts, recommend.search_index(_catalog(v)), v.expansions, _catalog(v) if fuzzy else None)


@query
def g4_search(v):
    return rounded(_matches(v, False))


@query
def g5_search_fuzzy(v):
    return rounded(_matches(v))


@query
def g6_cosine_affinity(v):
    return rounded(recommend.cosine_affinity(v.person_profiles, _catalog(v)))


def _requests(v):
    return v.proposals.select("form_id", "texto").join(v.prefs.select("form_id", F.when(F.col("nivel_max") != "sin_especificar", F.col("nivel_max")).alias("nivel"), F.when(F.col("institucion") != "indiferente", F.col("institucion")).alias("institucion")), "form_id")


@query
def g7_context_score(v):
    """Of each form and the entries that its texts match."""
    asked = _requests(v).withColumn("q", T.normalize("texto")).join(_matches(v).select("q", "ord"), "q").select("form_id", "nivel", "institucion", "ord").distinct()
    r = asked.join(_catalog(v).select("ord", F.col("nivel").alias("niveles"), F.col("institucion").alias("instituciones")), "ord")
    return r.select("form_id", "ord", F.round(recommend.context_score(F.col("nivel"), F.col("institucion"), F.col("niveles"), F.col("instituciones")), 6).alias("contexto"))


@once
def _recommended(v, k=3):
    return recommend.recommend(_requests(v), v.person_profiles, _matches(v), _catalog(v), k)


@query
def g8_recommend(v):
    return rounded(_recommended(v).drop("carrera"))


@query
def g9_coherence(v):
    return rounded(recommend.coherence(_recommended(v), _catalog(v)))


@query
def g10_conflict_alert(v):
    return recommend.conflict_alert(_recommended(v))


@query
def g11_unmatched(v):
    """A row for each alternative."""
    lost = recommend.unmatched(_requests(v), _matches(v), v.person_profiles, _catalog(v))
    return rounded(lost.select("form_id", "texto", "mensaje", F.posexplode_outer("alternativas").alias("lugar", "a")).select("form_id", "texto", "mensaje", (F.col("lugar") + 1).alias("lugar"), "a.carrera", "a.afinidad"))


@query
def g12_explain(v):
    r = _recommended(v)
    return recommend.explain(v.person_profiles, r, recommend.coherence(r, _catalog(v)))


@query
def g13_empty_requests(v):
    return recommend.empty_requests(v.forms, v.texts)


@query
def g14_dedupe_requests(v):
    r = _requests(v).withColumn("form", F.col("form_id")).drop("form_id").withColumnRenamed("form", "form_id")
    unique, of = recommend.dedupe_requests(r, ["texto", "nivel", "institucion"])
    return of.groupBy("request_key").agg(F.count(F.lit(1)).alias("n")).join(unique, "request_key").drop("request_key")


@query
def g14_recommend_once(v):
    return rounded(recommend.recommend_once(_requests(v), v.person_profiles, _matches(v), _catalog(v)).drop("carrera"))


def _official(v, recommended):
    """The main catalogue's name of every recommended entry."""
    return affinity.closest_name(recommended.select(F.col("carrera").alias("texto")).distinct(), v.careers)


@query
def g15_interpret(v):
    r = _recommended(v, 5)
    i = recommend.interpret(r, _official(v, r))
    measures = ("carrera", "match", "afinidad", "score")
    every = F.concat(F.array(F.struct(*measures)), "alternativas")
    return rounded(i.select("form_id", F.posexplode(every).alias("lugar", "x")).select("form_id", (F.col("lugar") + 1).alias("lugar"), "x.*"))


# ---- proposals


@query
def h1_career_level(v):
    return proposal.career_level(v.careers, v.level_lists)


def _places(v):
    return proposal.institution_sets(v.institutions.withColumn("institucion", F.when(F.col("institucion") == "publica", "publico").otherwise(F.col("institucion"))), {"publico": "publica"})


@query
def h2_affordable(v):
    df = linked(v.prefs, v.careers, 1 + F.col("form_id") % 64, "left").select("form_id", "carrera", "nivel_max", "institucion").join(proposal.career_level(v.careers, v.level_lists), "carrera", "left")
    return proposal.affordable(df.withColumn("nivel", F.coalesce("nivel", F.lit("universitario"))), _places(v)).select("form_id", "carrera", "financiable", "descarte")


def _types(v):
    return proposal.type_sets(affinity.career_index(v.career_types))


@query
def h3_type_score(v):
    df = linked(v.tops, v.careers, 1 + F.col("form_id") % 60).select("form_id", "carrera", "tipo1", "tipo2")
    return proposal.type_score(df, _types(v), v.related_types)


def _interpreted(v):
    """Texts that no name is similar to, read as free text: each is a request of its own, without wishes."""
    v.keep("proposals")
    open_ = v.proposals.withColumn("texto", F.trim("texto")).join(_named(v).where("carrera IS NULL").select("texto"), "texto")
    asked = settle(open_.select("form_id", "ord", "texto"), "open")
    key = F.concat_ws("-", "form_id", "ord")
    none = F.lit(None).cast("string")
    requests = asked.select(key.alias("form_id"), "texto", none.alias("nivel"), none.alias("institucion"))
    profiles = asked.select("form_id", key.alias("key")).join(v.person_profiles, "form_id").drop("form_id").withColumnRenamed("key", "form_id")
    r = settle(recommend.recommend(requests, profiles, _matches(v), _catalog(v), 5), "free")
    found = recommend.interpret(r, _official(v, r)).withColumnRenamed("form_id", "key")
    return asked.select("form_id", "ord", key.alias("key")).join(found, "key").drop("key")


def _proposals(v):
    return proposal.resolve_proposals(v.proposals, _named(v), _interpreted(v))


@once
def _proposed(v):
    return proposal.proposed_entries(_proposals(v))


def _tested(v):
    """Suggested entries in their order: those of the best pair, then those of the next."""
    s = _suggested(v).join(v.tops, "form_id")
    first = F.when(F.col("tipo") == F.col("tipo1"), 1).otherwise(2)
    return s.select("form_id", "carrera", (F.when(F.col("es_principal"), 0).otherwise(2) + first).alias("ord"))


@once
def _candidates(v):
    return proposal.universe(_tested(v), _proposed(v))


def _similarity(v):
    return proposal.career_similarity(proposal.asked_pairs(_candidates(v), _candidates(v)), _sets(v), _types(v))


@query
def h4_career_similarity(v):
    return _similarity(v)


@query
def h5_list_affinity(v):
    return rounded(proposal.list_affinity(_tested(v).select("form_id", "carrera"), _proposed(v), _similarity(v)))


@once
def _known_similarity(v):
    return _similarity(v)


def _scored(v):
    return proposal.career_score(_candidates(v), v.tops, _known_similarity(v), _types(v), v.related_types)


@query
def h6_career_score(v):
    return rounded(_scored(v).select("form_id", "carrera", "s_voc", "s_prop", "s_test", "score"))


@query
def h7_universe(v):
    return _candidates(v)


def _evaluated(v):
    return proposal.evaluate(_scored(v), proposal.career_level(v.careers, v.level_lists), v.prefs, _places(v))


@query
def h8_proposals(v):
    """Where each written text led: an entry of that name, an interpretation, or nowhere."""
    names = F.array_join(F.transform("alternativas", lambda x: x["carrera"]), ",").alias("alternativas")
    return rounded(_proposals(v).withColumn("alternativas", names))


@query
def h8_evaluate(v):
    return _evaluated(v).select("form_id", "carrera", "score", "estado", "rank", "descarte")


@query
def h9_final_view(v):
    return proposal.final_view(_evaluated(v).where("estado = 'final'"))


# ---- monitoring


@query
def m1_coverage_gaps(v):
    return monitor.coverage_gaps(v.careers, v.institutions)


@query
def m2_mapping_profile(v):
    return monitor.mapping_profile(v.institutions)


@query
def m3_compare_results(v):
    a = v.ranked.where("form_id % 11 <> 0").select("form_id", "tipo", "pd", "baremo", "posicion")
    b = v.ranked.where("form_id % 13 <> 0").select("form_id", "tipo", (F.col("pd") + F.when(F.col("form_id") % 5 == 0, 1).otherwise(0)).alias("pd"), "baremo", "posicion")
    return monitor.compare_results(a, b, ["form_id", "tipo"])


@query
def m4_run_stats(v):
    return rounded(monitor.run_stats(v.run_log))


@query
def m5_throughput(v):
    return rounded(monitor.throughput(v.run_log))


@query
def m6_missing_fields(v):
    rec = v.events.select("event_id", F.map_from_arrays(F.array(F.lit("tipo"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")), F.lit("nulo")), F.array(F.col("event_type"), F.lit("x"), F.when(F.col("event_id") % 2 == 0, F.lit("y")))).alias("campos"))
    return monitor.missing_fields(rec, ["tipo", "u0", "u1", "nulo"], "event_id").withColumns(joined("faltan"))
