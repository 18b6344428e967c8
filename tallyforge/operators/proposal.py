"""Evaluation of proposed entries: level, affordability, scores, and the final choice."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import dealt, small

# The ranks of levels, and the weights of a score.
HIERARCHY = {"sin_especificar": 3, "universitario": 3, "tecnico": 2, "cetpro": 1}
W_TYPE, W_PROPOSED, W_TEST, BONUS_PROPOSED, BONUS_TEST = 1.0, 2.5, 0.8, 20, 5


def career_level(careers: DataFrame, lists: DataFrame, default: str = "universitario") -> DataFrame:
    """carrera, nivel: by the list (carrera, nivel) that has it, cetpro before tecnico, else the default."""
    best = lists.groupBy("carrera").agg(F.min("nivel").alias("nivel"))
    return careers.select("carrera").distinct().join(best, "carrera", "left").select("carrera", F.coalesce("nivel", F.lit(default)).alias("nivel"))


def institution_sets(institutions: DataFrame, words: Mapping[str, str] | None = None) -> DataFrame:
    """carrera, instituciones (sorted). words: how the catalogue's words are read, where vocabularies differ."""
    word = F.col("institucion")
    if words:
        word = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), word), word)
    return institutions.groupBy("carrera").agg(F.array_sort(F.collect_set(word)).alias("instituciones"))


def affordable(df: DataFrame, institutions: DataFrame) -> DataFrame:
    """Adds `financiable` and `descarte`, why not: nivel or institucion.

    df: carrera (may be null), nivel, nivel_max, institucion. Entries whose institutions aren't known pass.
    """
    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for pair in HIERARCHY.items() for x in pair]), F.col(c))
    j = df.join(institutions, "carrera", "left")
    level = (F.col("nivel_max") != "sin_especificar") & (rank("nivel") > rank("nivel_max"))
    any_place = F.col("institucion").isin("sin_especificar", "indiferente") | F.col("carrera").isNull() | F.col("instituciones").isNull()
    place = ~any_place & ~F.array_contains("instituciones", F.col("institucion"))
    reason = F.when(F.coalesce(level, F.lit(False)), "nivel").when(F.coalesce(place, F.lit(False)), "institucion")
    return j.withColumn("descarte", reason).drop("instituciones").withColumn("financiable", F.col("descarte").isNull())


def type_sets(index: DataFrame) -> DataFrame:
    return index.groupBy("carrera").agg(F.array_sort(F.collect_set("tipo")).alias("tipos"))


def type_score(df: DataFrame, types: DataFrame, related: DataFrame) -> DataFrame:
    """Adds s_voc to rows of carrera, tipo1, tipo2: 8 for each of the two types, 4 for both, 2 for each related type of either."""
    rel = small(related.groupBy("tipo").agg(F.collect_list("rel").alias("rels")))
    none = F.array().cast("array<string>")
    j = df.join(small(types), "carrera", "left").withColumn("tipos", F.coalesce("tipos", none))
    for i in (1, 2):
        j = j.join(rel.select(F.col("tipo").alias(f"tipo{i}"), F.col("rels").alias(f"__r{i}")), f"tipo{i}", "left")
    has = lambda i: F.array_contains("tipos", F.col(f"tipo{i}"))
    near = lambda i: 2 * F.size(F.filter(F.coalesce(f"__r{i}", none), lambda r: F.array_contains("tipos", r)))
    score = F.when(has(1), 8).otherwise(0) + F.when(has(2), 8).otherwise(0) + F.when(has(1) & has(2), 4).otherwise(0) + near(1) + near(2)
    return j.select(*df.columns, score.cast("int").alias("s_voc"))


def asked_pairs(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """a, b: every pair of a candidate and another entry that some form lists, each once. Both: form_id, carrera."""
    # A form's entries are one row, and forms with the same entries are one.
    lists = lambda df, name: dealt(df.select("form_id", "carrera"), "form_id").groupBy("form_id").agg(F.array_sort(F.collect_set("carrera")).alias(name))
    met = lists(candidates, "xs").withColumn("ys", F.col("xs")) if listed is candidates else lists(candidates, "xs").join(lists(listed, "ys"), "form_id")
    pairs = met.select("xs", "ys").distinct().select(F.explode("xs").alias("a"), "ys").select("a", F.explode("ys").alias("b"))
    return pairs.where("a <> b").distinct()


def career_similarity(pairs: DataFrame, sets: DataFrame, types: DataFrame) -> DataFrame:
    """a, b, similitud of the pairs (a, b) of entries; an entry and itself have 0. Only pairs that forms ask for need be given."""
    none = F.array().cast("array<string>")
    full = sets.join(types, "carrera", "left").withColumn("tipos", F.coalesce("tipos", none))
    side = lambda x: full.select(F.col("carrera").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("grupos", "palabras", "tipos")])
    p = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    score = F.when(F.arrays_overlap("grupos_a", "grupos_b"), 4).otherwise(0) + 2 * F.least(F.size(F.array_intersect("palabras_a", "palabras_b")), F.lit(3)) + 3 * F.size(F.array_intersect("tipos_a", "tipos_b"))
    return p.select("a", "b", F.when(F.col("a") == F.col("b"), 0).otherwise(score).cast("double").alias("similitud"))


def list_affinity(candidates: DataFrame, listed: DataFrame, similarity: DataFrame, name: str = "afinidad") -> DataFrame:
    """Adds the mean similarity of each candidate (form_id, carrera) to the form's list (form_id, carrera) without itself; 0 if that is empty."""
    others = listed.select("form_id", F.col("carrera").alias("b")).distinct()
    pairs = candidates.select("form_id", F.col("carrera").alias("a")).distinct().join(others, "form_id").where("a <> b").join(similarity, ["a", "b"])
    mean = pairs.groupBy("form_id", F.col("a").alias("carrera")).agg(F.avg("similitud").alias(name))
    return candidates.join(mean, ["form_id", "carrera"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def total(s_voc: Column, s_prop: Column, s_test: Column, proposed: Column, suggested: Column) -> Column:
    bonus = F.when(proposed, BONUS_PROPOSED).otherwise(0) + F.when(suggested, BONUS_TEST).otherwise(0)
    return F.bround(s_voc * W_TYPE + s_prop * W_PROPOSED + s_test * W_TEST + bonus, 1)


def universe(suggested: DataFrame, proposed: DataFrame) -> DataFrame:
    """form_id, carrera, ord, en_test, en_alumno: suggested entries, then proposed ones, each once at its first place. Both: form_id, ord, carrera."""
    both = suggested.select("form_id", "carrera", F.struct(F.lit(0).alias("k"), "ord").alias("o")).unionByName(proposed.select("form_id", "carrera", F.struct(F.lit(1).alias("k"), "ord").alias("o")))
    g = dealt(both, "form_id").groupBy("form_id", "carrera").agg(F.min("o").alias("o"), F.max(F.col("o.k") == 0).alias("en_test"), F.max(F.col("o.k") == 1).alias("en_alumno"))
    return g.select("form_id", "carrera", F.row_number().over(Window.partitionBy("form_id").orderBy("o", "carrera")).alias("ord"), "en_test", "en_alumno")


def career_score(candidates: DataFrame, tops: DataFrame, similarity: DataFrame, types: DataFrame, related: DataFrame) -> DataFrame:
    """Candidates of universe() with s_voc, s_prop, s_test and score. Both means come from one pass over the pairs of a form, which stay in the form's task.

    Keep `similarity` written: it is counted before it is joined.
    """
    c = type_score(dealt(candidates, "form_id").join(tops, "form_id"), types, related)
    listed = dealt(candidates.select(F.col("form_id").alias("__f"), F.col("carrera").alias("b"), F.col("en_alumno").alias("__p"), F.col("en_test").alias("__t")), "__f")
    pairs = c.join(listed.hint("merge"), (F.col("form_id") == F.col("__f")) & (F.col("carrera") != F.col("b")), "left")
    pairs = pairs.join(small(similarity.select(F.col("a").alias("carrera"), "b", "similitud")), ["carrera", "b"], "left")
    mean = lambda which: F.coalesce(F.avg(F.when(F.col(which), F.col("similitud"))), F.lit(0.0))
    c = pairs.groupBy(*c.columns).agg(mean("__p").alias("s_prop"), mean("__t").alias("s_test"))
    return c.withColumn("score", total(F.col("s_voc"), F.col("s_prop"), F.col("s_test"), F.col("en_alumno"), F.col("en_test")))


def resolve_proposals(written: DataFrame, named: DataFrame, interpreted: DataFrame) -> DataFrame:
    """form_id, ord, texto, origen, carrera, match, afinidad, score, alternativas of every text that isn't blank.

    origen: nombre, if the catalogue has a similar name; interpretada, if free text led to an entry; else no_encontrada.
    written: form_id, ord, texto; named: of closest_name; interpreted: form_id, ord and the columns of interpret.
    """
    w = written.select("form_id", "ord", F.trim("texto").alias("texto")).where("texto <> ''").join(named.withColumnRenamed("carrera", "__named"), "texto", "left")
    j = w.join(interpreted, ["form_id", "ord"], "left")
    origin = F.when(F.col("__named").isNotNull(), "nombre").when(F.col("carrera").isNotNull(), "interpretada").otherwise("no_encontrada")
    free = lambda c: F.when(F.col("__named").isNull(), F.col(c)).alias(c)
    return j.select("form_id", "ord", "texto", origin.alias("origen"), F.coalesce("__named", "carrera").alias("carrera"), *[free(c) for c in ("match", "afinidad", "score", "alternativas")])


def proposed_entries(resolved: DataFrame) -> DataFrame:
    """form_id, carrera, ord: the entries that a form's texts lead to, each at its first place."""
    return resolved.where("carrera IS NOT NULL").groupBy("form_id", "carrera").agg(F.min("ord").alias("ord"))


def evaluate(scored: DataFrame, levels: DataFrame, prefs: DataFrame, institutions: DataFrame, k: int = 2) -> DataFrame:
    """Scored candidates with estado: final (with rank), reserva or descartada (with the reason). Ties keep the candidates' order."""
    j = affordable(scored.join(small(levels), "carrera", "left").join(prefs, "form_id"), small(institutions))
    order = Window.partitionBy("form_id", "financiable").orderBy(F.col("score").desc(), "ord")
    r = j.withColumn("__r", F.row_number().over(order))
    state = F.when(~F.col("financiable"), "descartada").when(F.col("__r") <= k, "final").otherwise("reserva")
    return r.withColumn("estado", state).withColumn("rank", F.when(F.col("estado") == "final", F.col("__r"))).drop("__r")


def final_view(finals: DataFrame) -> DataFrame:
    """form_id, rank, carrera, origen, pct of the form's best score, cut off and at most 100."""
    top = F.max("score").over(Window.partitionBy("form_id"))
    origin = F.when(F.col("en_test") & F.col("en_alumno"), "sintesis").when(F.col("en_alumno"), "alumno").when(F.col("en_test"), "test").otherwise("sintesis")
    return finals.select("form_id", "rank", "carrera", origin.alias("origen"), F.least(F.lit(100), F.floor(F.col("score") / F.when(top == 0, 1.0).otherwise(top) * 100)).cast("int").alias("pct"))
