"""Raw and normed scores, levels, rankings, profiles and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import dealt, small
from .marks import point

# Cut points of levels, and the texts of potentials.
CUTS = (39, 61)
POTENTIAL_TEXT = {"ALTO": "ALTO", "MEDIO": "EN DESARROLLO", "BAJO": "BAJO"}
KEY_ALIAS = {"investigativo": "investigacion", "emprendedor": "emprendimiento"}


def _form():
    return Window.partitionBy("form_id")


def raw_scores(marks: DataFrame, item_map: DataFrame, forms: DataFrame) -> DataFrame:
    """form_id, tipo, tipo_ord, pd_e, pd_p, pd_h, pd: points by type and block. Types without marks give 0.

    Answers are summed by form before types without any are filled in; the item map is a catalogue of at most a few items a type.
    Both sides are dealt over as many tasks as the session's shuffles have, as sums compress too well to put tasks together by their size.
    """
    hit = marks.where(point() == 1).select("form_id", "item").join(small(item_map), "item")
    block = lambda b: F.count_if(F.col("bloque") == b).alias(f"pd_{b.lower()}")
    sums = hit.groupBy("form_id", "tipo").agg(block("E"), block("P"), block("H"), F.count(F.lit(1)).alias("pd"))
    grid = dealt(forms.select("form_id"), "form_id").crossJoin(small(item_map.select("tipo", "tipo_ord").distinct()))
    filled = dealt(grid, "form_id", "tipo").join(dealt(sums, "form_id", "tipo").hint("merge"), ["form_id", "tipo"], "left")
    return filled.select("form_id", "tipo", "tipo_ord", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pd_e", "pd_p", "pd_h", "pd")])


def norm_scores(scores: DataFrame, norms: DataFrame, default_group: str = "M", groups: Sequence[str] = ("F", "M")) -> DataFrame:
    """Adds `baremo` by (sexo, tipo, pd); null where the table has none. Groups that the norms don't know use `default_group`."""
    group = F.when(F.col("sexo").isin(*groups), F.col("sexo")).otherwise(F.lit(default_group))
    table = norms.select(F.col("sexo").alias("__g"), "tipo", "pd", "baremo")
    return scores.withColumn("__g", group).join(table, ["__g", "tipo", "pd"], "left").drop("__g")


def level(col: str | Column = "baremo", cuts: tuple[float, float] = CUTS) -> Column:
    """bajo up to the first cut, alto from the second, medio between; null is sin_dato."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), "sin_dato").when(c <= cuts[0], "bajo").when(c >= cuts[1], "alto").otherwise("medio")


def with_level(df: DataFrame, cuts: tuple[float, float] = CUTS) -> DataFrame:
    return df.withColumn("nivel", level("baremo", cuts))


def level_by_range(df: DataFrame, ranges: DataFrame, value: str = "pd", default: str = "F") -> DataFrame:
    """Adds `nivel` by inclusive ranges (sexo, tipo, nivel, desde, hasta, ord) of the group and type; the first that fits, none gives bajo."""
    known = ranges.select(F.col("sexo").alias("__g"), "tipo", F.struct("ord", "nivel", "desde", "hasta").alias("r")).groupBy("__g", "tipo").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    joined = df.withColumn("__g", F.when(F.upper("sexo").isin("F", "M"), F.upper("sexo")).otherwise(F.lit(default))).join(known.hint("merge"), ["__g", "tipo"], "left")
    fits = F.filter("rs", lambda r: (F.col(value) >= r["desde"]) & (F.col(value) <= r["hasta"]))
    return joined.withColumn("nivel", F.coalesce(F.get(fits, F.lit(0))["nivel"], F.lit("bajo"))).drop("__g", "rs")


def rank_types(df: DataFrame) -> DataFrame:
    """Adds `posicion`: by norm, the missing last, then raw score, then the manual's order."""
    order = _form().orderBy(F.coalesce("baremo", F.lit(-1)).desc(), F.col("pd").desc(), "tipo_ord")
    return df.withColumn("posicion", F.row_number().over(order))


def top_types(ranked: DataFrame, k: int = 2) -> DataFrame:
    """tipo1 to tipo<k> of each form."""
    return ranked.where(F.col("posicion") <= k).groupBy("form_id").agg(*[F.max(F.when(F.col("posicion") == i, F.col("tipo"))).alias(f"tipo{i}") for i in range(1, k + 1)])


def type_key(df: DataFrame, col: str = "tipo", alias: Mapping[str, str] = KEY_ALIAS) -> DataFrame:
    """Adds `clave`: lower case, spaces to _, accents off, aliases resolved."""
    key = F.translate(F.lower(F.col(col)), " áéíóú", "_aeiou")
    known = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    return df.withColumn("clave", F.coalesce(F.element_at(known, key), key))


def potential_of(mode: str, enterprise: str, leader: str) -> Column:
    """The potential of a form as an aggregate over its types. enterprise: by the level of that type alone; both: alto needs the leader's level as well."""
    of = lambda t: F.coalesce(F.max(F.when(F.col("tipo") == t, F.col("nivel"))), F.lit("bajo"))
    e, l = of(enterprise), of(leader)  # noqa: E741
    high = e == "alto" if mode == "enterprise" else (e == "alto") & (l == "alto")
    middle = e == "medio" if mode == "enterprise" else e.isin("medio", "alto")
    return F.when(high, "ALTO").when(middle, "MEDIO").otherwise("BAJO")


def potential(levels: DataFrame, mode: str, enterprise: str, leader: str) -> DataFrame:
    """form_id, potencial, texto, by potential_of."""
    p = levels.groupBy("form_id").agg(potential_of(mode, enterprise, leader).alias("potencial"))
    return p.withColumn("texto", F.element_at(F.create_map(*[F.lit(x) for pair in POTENTIAL_TEXT.items() for x in pair]), F.col("potencial")))


def criteria_rollup(normed: DataFrame, criteria: DataFrame) -> DataFrame:
    """Per form and criterion: pd_total, baremo_max (missing norms as 0), tipos in manual order, and predominante, the first with the highest norm. criteria: criterio, crit_ord, tipo."""
    j = normed.join(criteria, "tipo")
    c = j.groupBy("form_id", "criterio", "crit_ord").agg(
        F.sum("pd").alias("pd_total"), F.max(F.coalesce("baremo", F.lit(0))).alias("baremo_max"), F.transform(F.array_sort(F.collect_list(F.struct("tipo_ord", "tipo"))), lambda s: s["tipo"]).alias("tipos")
    )
    first = F.row_number().over(_form().orderBy(F.col("baremo_max").desc(), "crit_ord")) == 1
    return c.withColumn("predominante", first).drop("crit_ord")


def profile_from_items(marks: DataFrame, areas: DataFrame) -> DataFrame:
    """Per form and area: the share of its items that are marked; unanswered items count as not marked, areas without items give 0. areas: area, item (null for an empty area)."""
    per = areas.groupBy("area").agg(F.count("item").alias("n"))
    hit = marks.where(point() == 1).join(small(areas), "item").groupBy("form_id", "area").agg(F.count(F.lit(1)).alias("k"))
    grid = marks.select("form_id").distinct().crossJoin(small(per))
    return grid.join(hit, ["form_id", "area"], "left").select("form_id", "area", F.when(F.col("n") > 0, F.coalesce("k", F.lit(0)) / F.col("n")).otherwise(0.0).alias("valor"))


LETTERS = ("r", "i", "a", "s", "e", "c")


def profile_from_norms(normed: DataFrame, letters: DataFrame) -> DataFrame:
    """Per form r, i, a, s, e, c: the mean norm of the letter's types over 99, at most 1, without data 0. letters: tipo, letra."""
    j = normed.join(small(letters), "tipo", "left")
    mean = lambda x: F.avg(F.when(F.col("letra") == x, F.col("baremo").cast("double")))
    return j.groupBy("form_id").agg(*[F.least(F.lit(1.0), F.coalesce(mean(x), F.lit(0.0)) / 99.0).alias(x) for x in LETTERS])


def level_counts(leveled: DataFrame) -> DataFrame:
    return leveled.groupBy("form_id").agg(*[F.count_if(F.col("nivel") == x).alias(x) for x in ("alto", "medio", "bajo", "sin_dato")])


def relative_level(df: DataFrame, value: str = "pd", group: Sequence[str] = ("form_id",)) -> DataFrame:
    """Adds `relativo`: alto from 80 % of the group's maximum, medio from 50 %, else bajo; sin_dato if the maximum isn't positive."""
    top = F.max(F.col(value)).over(Window.partitionBy(*group))
    pct = F.col(value) / top.cast("double") * 100
    return df.withColumn("relativo", F.when(top <= 0, "sin_dato").when(pct >= 80, "alto").when(pct >= 50, "medio").otherwise("bajo"))


def diff_vs_reference(df: DataFrame, reference: str = "first") -> DataFrame:
    """form_id, tipo, diff_pct against the reference row's norm, one decimal; rows without a norm, and the reference itself, are left out.

    reference: first in manual order, or max, the highest norm.
    """
    order = _form().orderBy("tipo_ord") if reference == "first" else _form().orderBy(F.col("baremo").desc_nulls_last(), "tipo_ord")
    r = df.withColumn("__at", F.row_number().over(order)).withColumn("__ref", F.max(F.when(F.col("__at") == 1, F.col("baremo"))).over(_form()))
    rows = r.where("__at > 1 AND baremo IS NOT NULL AND __ref IS NOT NULL AND __ref <> 0")
    return rows.select("form_id", "tipo", F.bround((F.col("baremo") - F.col("__ref")) / F.col("__ref").cast("double") * 100, 1).alias("diff_pct"))


def predominant(normed: DataFrame) -> DataFrame:
    """The type with the highest norm of each form, the first in manual order of equals; forms without norms have none."""
    best = F.row_number().over(_form().orderBy(F.col("baremo").desc(), "tipo_ord"))
    return normed.where("baremo IS NOT NULL").withColumn("__r", best).where("__r = 1").select("form_id", "tipo", "baremo")


def manual_order(df: DataFrame, order: DataFrame) -> DataFrame:
    """Adds `lugar`, the place in manual order; types that it doesn't know come last. order: tipo, manual."""
    j = df.join(small(order), "tipo", "left").withColumn("manual", F.coalesce("manual", F.lit(999)))
    return j.withColumn("lugar", F.row_number().over(_form().orderBy("manual", "tipo_ord"))).drop("manual")


def quick_report(scores: DataFrame, area_careers: DataFrame, enterprise: str, leader: str) -> DataFrame:
    """Per form: area_1, area_2 by raw score, the first four of their careers, each once, and the potential. scores: form_id, tipo, tipo_ord, pd, nivel; area_careers: tipo, ord, carrera.

    One aggregate over the scores; then each area brings the first four careers of its own, which are all that can be among the form's first four.
    """
    at = F.row_number().over(_form().orderBy(F.col("pd").desc(), "tipo_ord"))
    areas = [F.max(F.when(F.col("at") == i, F.col("tipo"))).alias(f"area_{i}") for i in (1, 2)]
    forms = scores.withColumn("at", at).groupBy("form_id").agg(*areas, potential_of("both", enterprise, leader).alias("potencial"))
    once = area_careers.groupBy("tipo", "carrera").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("tipo").orderBy("ord", "carrera"))
    four = once.withColumn("at", place).where("at <= 4").groupBy("tipo").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "carrera"))), lambda x: x["carrera"]).alias("cs"))
    none = F.array().cast("array<string>")
    for i in (1, 2):
        forms = forms.join(four.select(F.col("tipo").alias(f"area_{i}"), F.col("cs").alias(f"__c{i}")), f"area_{i}", "left")
    careers = F.slice(F.array_distinct(F.concat(F.coalesce("__c1", none), F.coalesce("__c2", none))), 1, 4)
    return forms.select("form_id", "area_1", "area_2", careers.alias("carreras_top"), "potencial")


def level_grid(leveled: DataFrame, types: Sequence[str], levels: Sequence[str] = ("bajo", "medio", "alto")) -> DataFrame:
    """Per form a column `<tipo>_<nivel>` of 0 or 1 for each type and level."""
    cell = lambda t, x: F.max(F.when((F.col("tipo") == t) & (F.col("nivel") == x), 1).otherwise(0)).alias(f"{t}_{x}")
    return leveled.groupBy("form_id").agg(*[cell(t, x) for t in types for x in levels])


def report_record(forms: DataFrame, quick: DataFrame) -> DataFrame:
    """The printed record: header fields, areas and the first two careers in upper case, empty if absent, and the grade with its sign."""
    shown = lambda c: F.coalesce(F.upper(F.translate(F.col(c), "_", " ")), F.lit(""))
    career = lambda i: F.coalesce(F.upper(F.get("carreras_top", F.lit(i))), F.lit(""))
    grade = F.trim(F.coalesce(F.col("grado"), F.lit("")))
    sign = F.when(grade == "", "").when(grade.endswith("°"), grade).otherwise(F.concat(grade, F.lit("°")))
    return forms.join(quick, "form_id").select(
        "form_id", F.col("nombre").alias("campo_nombre"), F.col("edad").cast("string").alias("campo_edad"), F.col("sexo").alias("campo_genero"), sign.alias("campo_grado_instruccion"),
        F.col("potencial").alias("potencial_puesto"), shown("area_1").alias("campo_areas"), shown("area_2").alias("campo_areas_2"), career(0).alias("campo_carreras"), career(1).alias("campo_carreras_2"),
    )


def plot_series(normed: DataFrame) -> DataFrame:
    """Bars of a form: norms (missing as 0) with their level, from the highest, and the end of the axis."""
    v = F.coalesce("baremo", F.lit(0))
    p = normed.select("form_id", "tipo", "tipo_ord", v.alias("valor"), level().alias("nivel"))
    p = p.withColumn("lugar", F.row_number().over(_form().orderBy(F.col("valor").desc(), "tipo_ord")))
    return p.withColumn("eje_max", F.greatest(F.lit(70), F.max("valor").over(_form())) + 10).drop("tipo_ord")


def score_forms(marks: DataFrame, forms: DataFrame, item_map: DataFrame, norms: DataFrame, enterprise: str, leader: str) -> DataFrame:
    """From answers to a record for each form: its two leading types with their levels, doubtful answers and the potential."""
    normed = norm_scores(raw_scores(marks, item_map, forms).join(forms.select("form_id", "sexo"), "form_id"), norms)
    ranked = with_level(rank_types(normed))
    pick = lambda i, c: F.max(F.when(F.col("posicion") == i, F.col(c)))
    return ranked.groupBy("form_id").agg(*[pick(i, c).alias(f"{c}{i}") for i in (1, 2) for c in ("tipo", "pd", "baremo", "nivel")], potential_of("enterprise", enterprise, leader).alias("potencial"))
