"""Catalogue indices, the affinity of catalogue entries, suggestions, and free text resolved to entries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alike, normalize, variants
from ..sources.storage import settle, small

# Weights of an affinity, and its verdicts.
WEIGHTS = {"regla": 5, "grupo": 3, "palabra": 1, "tipo": 2}
HIGH, MIDDLE = 10, 5
FUZZY = 0.72


def career_index(career_types: DataFrame, alias: DataFrame | None = None, dedupe: bool = True) -> DataFrame:
    """carrera, tipo with every alias of a type added (alias: tipo, alias). dedupe=False keeps a career's type under both names."""
    pairs = career_types.select("carrera", "tipo")
    if alias is not None:
        if dedupe:
            pairs = pairs.join(small(alias.select(F.col("alias").alias("tipo"), F.col("tipo").alias("__t"))), "tipo", "left").select("carrera", F.coalesce("__t", "tipo").alias("tipo"))
        else:
            pairs = pairs.unionByName(pairs.join(small(alias), "tipo").select("carrera", F.col("alias").alias("tipo")))
    return pairs.distinct()


def symmetric_rules(rules: DataFrame) -> DataFrame:
    """a, b, razon in both directions; of rules on the same pair the later (ord) holds."""
    both = rules.select("a", "b", "razon", "ord").unionByName(rules.select(F.col("b").alias("a"), F.col("a").alias("b"), "razon", "ord"))
    last = Window.partitionBy("a", "b").orderBy(F.col("ord").desc(), F.col("razon").desc())
    return both.where("a IS NOT NULL AND b IS NOT NULL").withColumn("__r", F.row_number().over(last)).where("__r = 1").select("a", "b", "razon")


def _sets(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.groupBy("carrera").agg(F.array_sort(F.collect_set(col)).alias(name))


def career_sets(careers: DataFrame, groups: DataFrame, keywords: DataFrame) -> DataFrame:
    """carrera with its sorted groups and keywords: one row for each entry of the catalogue."""
    none = F.array().cast("array<string>")
    c = careers.select("carrera").distinct().join(_sets(groups, "grupo", "grupos"), "carrera", "left").join(_sets(keywords, "palabra", "palabras"), "carrera", "left")
    return c.select("carrera", F.coalesce("grupos", none).alias("grupos"), F.coalesce("palabras", none).alias("palabras"))


def pair_affinity(pairs: DataFrame, sets: DataFrame, rules: DataFrame, related: DataFrame, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """Adds puntaje and relacion to pairs (a, b, tipo_a, tipo_b).

    A direct rule counts twice its weight; each shared group and keyword its own; a related type (from a to b) once. The
    label is the rule's, else the first shared group, else the first two shared keywords, else General; ties go by name.
    The catalogue tables are joined by their size, known from their files.
    """
    side = lambda x: sets.select(F.col("carrera").alias(x), F.col("grupos").alias(f"g_{x}"), F.col("palabras").alias(f"k_{x}"))
    near = related.select(F.col("tipo").alias("tipo_a"), F.col("rel").alias("tipo_b")).distinct().withColumn("near", F.lit(True))
    p = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").join(rules, ["a", "b"], "left").join(near, ["tipo_a", "tipo_b"], "left")
    none = F.array().cast("array<string>")
    groups = F.array_sort(F.array_intersect(F.coalesce("g_a", none), F.coalesce("g_b", none)))
    words = F.array_sort(F.array_intersect(F.coalesce("k_a", none), F.coalesce("k_b", none)))
    score = F.when(F.col("razon").isNotNull(), 2 * weights["regla"]).otherwise(0) + weights["grupo"] * F.size(groups) + weights["palabra"] * F.size(words) + F.when(F.col("near"), weights["tipo"]).otherwise(0)
    label = F.coalesce(F.col("razon"), F.get(groups, F.lit(0)), F.when(F.size(words) > 0, F.concat(F.lit("Área "), F.array_join(F.slice(words, 1, 2), ", "))), F.lit("General"))
    return p.select(*pairs.columns, score.cast("int").alias("puntaje"), label.alias("relacion"))


def type_pairs(career_types: DataFrame) -> DataFrame:
    """Every pair of an entry of one type and another entry of another type: tipo_a, tipo_b, a, b, ord_a, ord_b.

    Pairs of types come first, a few dozen; entries join them by type. The result grows with the catalogue alone, whatever the number of forms.
    """
    side = lambda x: career_types.select(F.col("tipo").alias(f"tipo_{x}"), F.col("carrera").alias(x), F.col("ord").alias(f"ord_{x}"))
    kinds = career_types.select("tipo").distinct()
    kinds = kinds.select(F.col("tipo").alias("tipo_a")).join(kinds.select(F.col("tipo").alias("tipo_b")), F.col("tipo_a") != F.col("tipo_b"))
    return kinds.join(side("a"), "tipo_a").join(side("b"), "tipo_b").where("a <> b").select("tipo_a", "tipo_b", "a", "b", "ord_a", "ord_b")


def leading_pairs(career_types: DataFrame, sets: DataFrame, rules: DataFrame, deep: int = 4, widest: int = 10) -> DataFrame:
    """The pairs of type_pairs among which best_two_pairs finds the same two as among all: tipo_a, tipo_b, a, b, ord_a, ord_b. Grows with the lists, not with the catalogue's square.

    A pair without a rule scores what its common groups and keywords weigh, so for each set of these it is enough to know
    the `deep` first entries of each type that have them all: of a better pair's entries, one that is not among them
    could be exchanged for an earlier one. Two may be taken by the best pair and one may be its partner, so four are
    enough. The empty set stands for pairs that share nothing. Pairs with a rule come by the rule. The sets of an entry
    are 2 to the power of its groups and keywords; entries with more than `widest` meet all that share one of them instead.
    """
    if deep < 4:
        raise ValueError("four entries of each list are needed")
    marked = F.array_union(F.transform("grupos", lambda x: F.concat(F.lit("g"), x)), F.transform("palabras", lambda x: F.concat(F.lit("p"), x)))
    own = settle(career_types.select("tipo", "carrera", "ord").join(sets.select("carrera", F.array_sort(marked).alias("has")), "carrera").withColumn("wide", F.size("has") > widest), "features")
    bits = F.when(F.col("wide"), 0).otherwise(F.call_function("shiftleft", F.lit(1), F.size("has")) - 1)
    each = own.select("tipo", "carrera", "ord", "has", F.explode(F.sequence(F.lit(0), bits)).alias("bits"))
    each = each.select("tipo", "carrera", "ord", F.filter("has", lambda x, i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1).alias("common"))
    lists = each.withColumn("__r", F.row_number().over(Window.partitionBy("tipo", "common").orderBy("ord", "carrera"))).where(F.col("__r") <= deep)
    lists = settle(lists.drop("__r"), "lists")
    side = lambda df, x: df.select(F.col("tipo").alias(f"tipo_{x}"), F.col("carrera").alias(x), F.col("ord").alias(f"ord_{x}"), *[c for c in ("common", "wide") if c in df.columns])
    columns = ["tipo_a", "tipo_b", "a", "b", "ord_a", "ord_b"]
    apart = (F.col("tipo_a") != F.col("tipo_b")) & (F.col("a") != F.col("b"))
    sharing = side(lists, "a").join(side(lists, "b").hint("merge"), "common").where(apart).select(*columns)
    one = own.select("tipo", "carrera", "ord", "wide", F.explode("has").alias("common"))
    wide, any_ = side(one.where("wide"), "a").drop("wide"), side(one, "b").drop("wide")
    met = wide.join(any_.hint("merge"), "common").where(apart).select(*columns)
    turned = met.select(F.col("tipo_b").alias("tipo_a"), F.col("tipo_a").alias("tipo_b"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("ord_b").alias("ord_a"), F.col("ord_a").alias("ord_b"))
    plain = own.select("tipo", "carrera", "ord")
    ruled = rules.select("a", "b").join(side(plain, "a").hint("merge"), "a").join(side(plain, "b").hint("merge"), "b").where(apart).select(*columns)
    return sharing.unionByName(met).unionByName(turned).unionByName(ruled).distinct()


def best_two_pairs(scored: DataFrame) -> DataFrame:
    """The best pair of each (tipo_a, tipo_b), and the best that shares no entry with it, as rango 1 and 2. Keep `scored` written, it is read twice."""
    types, shown = ["tipo_a", "tipo_b"], ["a", "b", "puntaje", "relacion"]
    best = F.min_by(F.struct(*shown), F.struct((-F.col("puntaje")).alias("p"), "ord_a", "ord_b")).alias("x")
    first = scored.groupBy(*types).agg(best)
    taken = first.select(*types, F.col("x.a").alias("a1"), F.col("x.b").alias("b1"))
    apart = ~F.col("a").isin(F.col("a1"), F.col("b1")) & ~F.col("b").isin(F.col("a1"), F.col("b1"))
    second = scored.join(taken, types).where(apart).groupBy(*types).agg(best)
    rank = lambda df, i: df.select(*types, F.lit(i).alias("rango"), "x.*")
    return rank(first, 1).unionByName(rank(second, 2))


def suggest(tops: DataFrame, pairs: DataFrame) -> DataFrame:
    """form_id, carrera, tipo, es_principal, puntaje, relacion: four entries for the two leading types of each form. pairs: best_two_pairs, a few rows for each pair of types."""
    p = pairs.withColumnsRenamed({"tipo_a": "tipo1", "tipo_b": "tipo2"})
    two = F.array(F.struct(F.col("a").alias("carrera"), F.col("tipo1").alias("tipo")), F.struct(F.col("b").alias("carrera"), F.col("tipo2").alias("tipo")))
    j = tops.join(p, ["tipo1", "tipo2"]).select("form_id", F.explode(two).alias("c"), (F.col("rango") == 1).alias("es_principal"), "puntaje", "relacion")
    return j.select("form_id", "c.carrera", "c.tipo", "es_principal", "puntaje", "relacion")


def verdict(score: str | Column = "puntaje") -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= HIGH, "alta").when(s >= MIDDLE, "media").otherwise("baja")


def best_affinity(pairs: DataFrame, index: DataFrame, sets: DataFrame, rules: DataFrame, related: DataFrame) -> DataFrame:
    """The best affinity of each pair of entries (a, b) over their types; ties by the names of the types."""
    t = lambda x: index.select(F.col("carrera").alias(x), F.col("tipo").alias(f"tipo_{x}"))
    scored = pair_affinity(pairs.select("a", "b").distinct().join(t("a"), "a").join(t("b"), "b"), sets, rules, related)
    w = Window.partitionBy("a", "b").orderBy(F.col("puntaje").desc(), "tipo_a", "tipo_b")
    return scored.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def resolve_names(texts: DataFrame, careers: DataFrame, aliases: DataFrame, keywords: DataFrame, fuzzy: bool = True, text: str = "texto") -> DataFrame:
    """texto_norm, carrera, paso for every distinct normalized text: the first tier that knows it.

    Tiers: 1 alias, 2 singular and plural of an alias, 3 name, 4 keyword (shortest name), 5 shared name tokens of 4
    characters or more (most, then shortest name), 6 similarity of 0.72 with a name or a word of 5 characters. Each
    tier is a join on what the ones before left; the last compares texts with the names that can be similar. Ties go by name.
    """
    todo = settle(texts.select(normalize(text).alias("q")).where("q <> ''").distinct(), "asked")
    cat = careers.select("carrera", normalize("carrera").alias("nombre")).distinct()
    known = aliases.join(cat.select("carrera"), "carrera", "left_semi").select(normalize("alias").alias("q"), "carrera")
    by_alias = known.groupBy("q").agg(F.max("carrera").alias("carrera"))

    def tier(rows: DataFrame, step: int) -> DataFrame:
        return rows.select("q", "carrera", F.lit(step).alias("paso"))

    def first(rows: DataFrame, *order) -> DataFrame:
        return rows.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where("__r = 1")

    t1 = tier(todo.join(by_alias, "q"), 1)
    spelled = todo.select("q", F.posexplode(variants("q")).alias("at", "v"))
    t2 = tier(first(spelled.join(by_alias.withColumnRenamed("q", "v").hint("merge"), "v"), "at"), 2)
    t3 = tier(first(todo.join(cat.withColumnRenamed("nombre", "q"), "q"), "carrera"), 3)
    kw = keywords.join(cat.select("carrera"), "carrera", "left_semi").select(normalize("palabra").alias("q"), "carrera").where("q <> ''").distinct()
    t4 = tier(first(todo.join(kw.hint("merge"), "q"), F.length("carrera"), "carrera"), 4)
    token = lambda c: F.explode(F.filter(F.split(F.col(c), " "), lambda w: F.length(w) >= 4))
    names = cat.select("carrera", token("nombre").alias("t")).distinct()
    shared = todo.select("q", token("q").alias("t")).join(names.hint("merge"), "t").groupBy("q", "carrera").agg(F.count(F.lit(1)).alias("n"))
    t5 = tier(first(shared, F.col("n").desc(), F.length("carrera"), "carrera"), 5)
    found = settle(first(t1.unionByName(t2).unionByName(t3).unionByName(t4).unionByName(t5), "paso").drop("__r"), "found")
    if fuzzy:
        rest = todo.join(found, "q", "left_anti").where(F.length("q") >= 4)
        forms = cat.select("carrera", "nombre").unionByName(cat.select("carrera", F.explode(F.filter(F.split("nombre", " "), lambda w: F.length(w) >= 5)).alias("nombre")))
        near = alike(rest.withColumnRenamed("q", "text"), forms.withColumnRenamed("nombre", "name"), FUZZY)
        named = near.withColumnsRenamed({"text": "q", "name": "nombre"}).join(forms.distinct().hint("merge"), "nombre")
        found = found.unionByName(tier(first(named, F.col("sim").desc(), "carrera"), 6))
    return found.select(F.col("q").alias("texto_norm"), "carrera", "paso")


def analyze_written(written: DataFrame, suggested: DataFrame, resolved: DataFrame, index: DataFrame, sets: DataFrame, rules: DataFrame, related: DataFrame) -> DataFrame:
    """Written entries (form_id, ord, texto) against those suggested (form_id, carrera): estado, carrera, carrera_test, puntaje, relacion, veredicto, afinidad_alta.

    States: vacio, no_reconocida, sin_match (no types, or nothing to compare with), analizada. Affinities are computed once for each distinct pair.
    """
    w = written.withColumn("texto_norm", normalize("texto")).join(resolved.select("texto_norm", "carrera"), "texto_norm", "left")
    pairs = w.where("carrera IS NOT NULL").select("form_id", "ord", F.col("carrera").alias("a")).join(suggested.select("form_id", F.col("carrera").alias("b")).distinct(), "form_id")
    best = best_affinity(pairs, index, sets, rules, related).select("a", "b", "puntaje", "relacion")
    order = Window.partitionBy("form_id", "ord").orderBy(F.col("puntaje").desc(), "b")
    match = pairs.join(best, ["a", "b"]).withColumn("__r", F.row_number().over(order)).where("__r = 1").select("form_id", "ord", F.col("b").alias("carrera_test"), "puntaje", "relacion")
    out = w.join(match, ["form_id", "ord"], "left")
    state = F.when(F.trim(F.coalesce("texto", F.lit(""))) == "", "vacio").when(F.col("carrera").isNull(), "no_reconocida").when(F.col("puntaje").isNull(), "sin_match").otherwise("analizada")
    out = out.withColumn("estado", state)
    grade = F.when(F.col("estado") == "analizada", verdict()).when(F.col("estado") == "sin_match", "baja").when(F.col("estado") == "no_reconocida", "desconocida")
    return out.select("form_id", "ord", "texto", "estado", "carrera", "carrera_test", "puntaje", "relacion", grade.alias("veredicto"), F.coalesce(F.col("puntaje") >= HIGH, F.lit(False)).alias("afinidad_alta"))


def closest_name(texts: DataFrame, careers: DataFrame, cutoff: float = 0.62, text: str = "texto") -> DataFrame:
    """texto, carrera for every distinct text that isn't blank: the entry equal but for case, else the most similar one of at least `cutoff`, the later name first."""
    todo = settle(texts.select(F.trim(text).alias("texto")).where("texto <> ''").distinct(), "named")
    cat = careers.select("carrera").distinct()
    same = todo.join(cat, F.lower("texto") == F.lower("carrera")).groupBy("texto").agg(F.min("carrera").alias("carrera"))
    rest = todo.join(same, "texto", "left_anti")
    near = alike(rest.withColumnRenamed("texto", "text"), cat.withColumnRenamed("carrera", "name"), cutoff, names_first=True).withColumnsRenamed({"text": "texto", "name": "carrera"})
    best = near.withColumn("__r", F.row_number().over(Window.partitionBy("texto").orderBy(F.col("sim").desc(), F.col("carrera").desc()))).where("__r = 1").select("texto", "carrera")
    return todo.join(same.unionByName(best).hint("merge"), "texto", "left")
