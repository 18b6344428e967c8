"""Search of the catalogue by free text, and recommendations from profile, text and context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alike, normalize, stem
from ..sources.storage import is_small, settle, small

# Thresholds of the search and weights of the blend.
OVERLAP, FUZZY_ALIAS, FUZZY_KEYWORD, FUZZY_FACTOR, CANDIDATES = 0.34, 0.85, 0.78, 0.9, 8
W_TEST, W_TEXT, W_CONTEXT, LEAST_MATCH = 0.55, 0.30, 0.15, 0.30
TRUSTED, INCOHERENT, COHERENT = 0.60, 0.55, 0.80
LETTERS = ("r", "i", "a", "s", "e", "c")
# Names of the areas in explanations.
AREAS = {
    "r": "Realista (práctico, manual, técnico)", "i": "Investigador (analítico, científico)", "a": "Artístico (creativo, expresivo)",
    "s": "Social (ayudar, enseñar, cuidar)", "e": "Emprendedor (liderar, persuadir)", "c": "Convencional (organizar, sistematizar)",
}

# The sentences of an explanation.
SENTENCES = {
    "areas": "Tu perfil del test destaca en %s (%.2f), seguido de %s (%.2f).",
    "first": "De lo que escribiste, la carrera con mejor encaje es '%s' (afinidad con el test: %.2f, similitud con tu texto: %.2f).",
    "second": "En segundo lugar aparece '%s' (afinidad: %.2f).",
    "alert": "⚠️ ALERTA: lo que escribiste tiene afinidad baja con tu perfil del test. Puede que tu interés no coincida con tus aptitudes. Recomendamos revisar esto con un orientador.",
    "apart": "Las carreras que mencionaste son poco coherentes entre sí (coherencia: %.2f). Aún estás explorando opciones diversas. Considera enfocarte en un área.",
    "together": "Las carreras que mencionaste son muy coherentes entre sí (coherencia: %.2f). Tienes una dirección clara.",
    "none": "No se encontró ninguna carrera del catálogo que coincida con lo que escribiste. Intenta con el nombre completo o sinónimos.",
}


# Fixed value: what is said of a text that no entry matches.
NOT_FOUND = "'%s' no está en el catálogo. ¿Quizás quisiste decir una de estas carreras que encajan con tu perfil del test?"


def search_index(catalog: DataFrame) -> dict[str, DataFrame]:
    """alias (alias, ord: names included, the last entry wins), phrase (frase, ord), token (token, ord: 3 characters or more) of a catalogue (ord, carrera, alias, keywords)."""
    named = catalog.select(normalize("carrera").alias("alias"), "ord").unionByName(catalog.select(F.explode("alias").alias("x"), "ord").select(normalize("x").alias("alias"), "ord"))
    phrases = catalog.select("ord", F.explode("keywords").alias("k")).select(normalize("k").alias("frase"), "ord")
    tokens = phrases.select(F.explode(F.split("frase", " ")).alias("token"), "ord").where(F.length("token") >= 3)
    return {"alias": named.where("alias <> ''").groupBy("alias").agg(F.max("ord").alias("ord")), "phrase": phrases, "token": tokens.distinct()}


def expand_tokens(tokens: DataFrame, expansions: DataFrame, key: str = "q") -> DataFrame:
    """key, token: each token, its stem, and the expansions (token, expansion) of the token, the stem and the stem with s, each once."""
    forms = tokens.select(key, F.explode(F.array_distinct(F.array(F.col("token"), stem("token"), F.concat(stem("token"), F.lit("s"))))).alias("form"))
    more = forms.join(expansions.select(F.col("token").alias("form"), "expansion").hint("merge"), "form").select(key, F.col("expansion").alias("token"))
    own = tokens.select(key, F.explode(F.array(F.col("token"), stem("token"))).alias("token"))
    return own.unionByName(more).distinct()


def search(texts: DataFrame, index: dict[str, DataFrame], expansions: DataFrame, catalog: DataFrame | None = None, k: int = 3, text: str = "texto") -> DataFrame:
    """q, ord, score, nivel, lugar: the k best entries of each distinct normalized text.

    1: an alias or a name, score 1. 2: expanded tokens met in the inverted index, and 2 for the whole phrase, over the
    number of original tokens, if the best reaches 0.34. 3, with a catalogue: similarity to the best 8 of tier 2, or to
    all entries if it has none. Ties go by the entry's number.
    """
    todo = settle(texts.select(normalize(text).alias("q")).where("q <> ''").distinct(), "asked")
    exact = todo.join(index["alias"].withColumnRenamed("alias", "q").hint("merge"), "q").select("q", "ord", F.lit(1.0).alias("score"), F.lit(1).alias("nivel"))
    rest = todo.join(exact.select("q").hint("merge"), "q", "left_anti")
    words = rest.select("q", F.explode(F.split("q", " ")).alias("token")).where(F.length("token") >= 3)
    counts = words.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    hits = expand_tokens(words, expansions).join(index["token"].hint("merge"), "token").select("q", "ord", F.lit(1.0).alias("p"))
    bonus = words.select("q").distinct().join(index["phrase"].withColumnRenamed("frase", "q").hint("merge"), "q").select("q", "ord", F.lit(2.0).alias("p"))
    scored = hits.unionByName(bonus).groupBy("q", "ord").agg(F.sum("p").alias("p")).join(counts.hint("merge"), "q").select("q", "ord", (F.col("p") / F.col("n")).alias("score"))
    scored = settle(scored.withColumn("best", F.max("score").over(Window.partitionBy("q"))), "token_scores")
    by_token = scored.where(F.col("best") >= OVERLAP).select("q", "ord", "score", F.lit(2).alias("nivel"))
    out = exact.unionByName(by_token)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "ord")
    if catalog is not None:
        weak = scored.where(F.col("best") < OVERLAP).withColumn("at", F.row_number().over(order)).where(F.col("at") <= CANDIDATES).select("q", "ord")
        none = rest.join(scored.select("q"), "q", "left_anti").select("q", F.lit(None).cast("int").alias("ord"))
        out = out.unionByName(search_fuzzy(weak.unionByName(none), catalog).withColumn("nivel", F.lit(3)))
    return out.withColumn("lugar", F.row_number().over(order)).where(F.col("lugar") <= k)


def search_fuzzy(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """q, ord, score of candidates (q, ord; a null ord stands for every entry) whose best similarity to name, aliases or keywords reaches 0.78, times 0.9.

    Aliases count in their order, up to the first one of 0.85 or more that is nearer than the name. Texts are compared
    once with each distinct phrase of the catalogue that can be similar; phrases below 0.78 decide nothing.
    """
    said = lambda kind, words: catalog.select("ord", F.lit(kind).alias("kind"), F.posexplode(words).alias("pos", "x"))
    phrases = said("name", F.array("carrera")).unionByName(said("alias", F.col("alias"))).unionByName(said("keyword", F.col("keywords")))
    phrases = settle(phrases.select("ord", "kind", "pos", normalize("x").alias("name")), "phrases")
    candidates = settle(candidates, "candidates")
    near = alike(candidates.select(F.col("q").alias("text")), phrases, FUZZY_KEYWORD).join(phrases.hint("merge"), "name").select(F.col("text").alias("q"), "ord", "kind", "pos", "sim")
    wanted = F.col("c.q").eqNullSafe(F.col("n.q")) & (F.col("c.ord").isNull() | (F.col("c.ord") == F.col("n.ord")))
    pairs = near.alias("n").join(candidates.alias("c").hint("merge"), wanted, "left_semi")
    of = Window.partitionBy("q", "ord")
    pairs = pairs.withColumn("named", F.coalesce(F.max(F.when(F.col("kind") == "name", F.col("sim"))).over(of), F.lit(0.0)))
    stops = (F.col("kind") == "alias") & (F.col("sim") >= FUZZY_ALIAS) & (F.col("sim") > F.col("named"))
    pairs = pairs.withColumn("stop", F.min(F.when(stops, F.col("pos"))).over(of))
    read = (F.col("kind") != "alias") | F.col("stop").isNull() | (F.col("pos") <= F.col("stop"))
    return pairs.where(read).groupBy("q", "ord").agg((F.max("sim") * FUZZY_FACTOR).alias("score"))


def _dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b, strict=True)])


def unit(prefix: str = "") -> list[Column]:
    """The six letters over their norm; a norm of zero leaves zeros."""
    v = [F.col(prefix + x) for x in LETTERS]
    norm = F.sqrt(_dot(v, v))
    return [F.when(norm < 1e-9, 0.0).otherwise(x / norm) for x in v]


def with_unit(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{x}": u for x, u in zip(LETTERS, unit(), strict=True)})


def cosine_affinity(profiles: DataFrame, catalog: DataFrame, key: str = "form_id", block: int = 10_000) -> DataFrame:
    """key, ord, afinidad of every profile to every entry: six products a pair, no arrays. A catalogue of at most `block` entries is broadcast; a larger one is met block by block."""
    c = with_unit(catalog, "c_").select("ord", *[f"c_{x}" for x in LETTERS])
    p = with_unit(profiles, "p_").select(key, *[f"p_{x}" for x in LETTERS])
    if is_small(catalog, block):
        met = p.crossJoin(F.broadcast(c))
    else:
        blocks = -(-catalog.count() // block)
        met = p.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(c.withColumn("__b", F.pmod("ord", F.lit(blocks)).cast("int")).hint("shuffle_hash"), "__b")
    return met.select(key, "ord", _dot([F.col(f"p_{x}") for x in LETTERS], [F.col(f"c_{x}") for x in LETTERS]).alias("afinidad"))


def context_score(level: Column, institution: Column, levels: Column, institutions: Column) -> Column:
    """0.5, moved by whether the wished level and institution are among the entry's; wishes left out don't count."""
    wished = lambda c: c.isNotNull() & (c != "")
    a = F.when(~wished(level), 0.0).when(F.array_contains(levels, level), 0.25).otherwise(-0.20)
    b = F.when(~wished(institution), 0.0).when(F.array_contains(institutions, institution), 0.25).otherwise(-0.15)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + a + b))


def recommend(requests: DataFrame, profiles: DataFrame, matches: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """form_id, lugar, ord, carrera, texto, afinidad, match, contexto, score: the k best entries of each form.

    requests: form_id, texto, nivel, institucion; matches: of search(); catalog: ord, carrera, nivel, institucion and
    the six letters. An entry keeps its best text. Affinities are computed for matched entries only.
    """
    asked = requests.withColumn("q", normalize("texto")).join(matches.where(F.col("score") >= LEAST_MATCH).select("q", "ord", F.col("score").alias("match")), "q")
    c = with_unit(catalog, "c_").select("ord", "carrera", F.col("nivel").alias("niveles"), F.col("institucion").alias("instituciones"), *[f"c_{x}" for x in LETTERS])
    p = with_unit(profiles, "p_").select("form_id", *[f"p_{x}" for x in LETTERS])
    j = asked.join(c, "ord").join(p, "form_id")
    affinity = _dot([F.col(f"p_{x}") for x in LETTERS], [F.col(f"c_{x}") for x in LETTERS])
    context = context_score(F.col("nivel"), F.col("institucion"), F.col("niveles"), F.col("instituciones"))
    s = j.withColumn("afinidad", affinity).withColumn("contexto", context).withColumn("score", W_TEST * F.col("afinidad") + W_TEXT * F.col("match") + W_CONTEXT * F.col("contexto"))
    best = s.withColumn("__r", F.row_number().over(Window.partitionBy("form_id", "ord").orderBy(F.col("score").desc(), "texto"))).where("__r = 1")
    ranked = best.withColumn("lugar", F.row_number().over(Window.partitionBy("form_id").orderBy(F.col("score").desc(), "ord"))).where(F.col("lugar") <= k)
    return ranked.select("form_id", "lugar", "ord", "carrera", "texto", "afinidad", "match", "contexto", "score")


def coherence(chosen: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per form the mean cosine between its chosen entries (form_id, ord), 0.5 for fewer than two.

    By sums: the squared length of the sum of n unit vectors is n plus twice the sum over pairs, so no pairs are built.
    """
    c = with_unit(catalog, "c_").select("ord", *[f"c_{x}" for x in LETTERS])
    j = chosen.select("form_id", "ord").join(c, "ord")
    own = _dot([F.col(f"c_{x}") for x in LETTERS], [F.col(f"c_{x}") for x in LETTERS])
    g = j.groupBy("form_id").agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("own"), *[F.sum(f"c_{x}").alias(x) for x in LETTERS])
    square = _dot([F.col(x) for x in LETTERS], [F.col(x) for x in LETTERS])
    return g.select("form_id", F.when(F.col("n") < 2, 0.5).otherwise((square - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("coherencia"))


def conflict_alert(recommended: DataFrame) -> DataFrame:
    """Per form whether its first entry's affinity to the profile is below 0.60."""
    return recommended.where("lugar = 1").select("form_id", (F.col("afinidad") < TRUSTED).alias("alerta"))


def nearest_entries(profiles: DataFrame, catalog: DataFrame, k: int = 3, key: str = "form_id", digits: int = 9) -> DataFrame:
    """key, lugar, ord, carrera, afinidad: the k entries of highest affinity to each profile, rounded to `digits`, ties by the entry's number. The same as of cosine_affinity, without its pairs.

    The catalogue is dealt to about as many balls as the square root of its entries, each around an entry. A profile meets
    the centres, and the entries of the nearest ball that has k; the k-th of these is a bound. Of the other balls only those
    are met whose nearest possible entry reaches it: by the triangle inequality of angles, none of the k is elsewhere.
    """
    units = settle(with_unit(catalog, "c_").select("ord", "carrera", *[f"c_{x}" for x in LETTERS]), "units")
    n = units.count()
    balls = max(1, round(n**0.5))
    centres = units.orderBy(F.xxhash64("ord"), "ord").limit(balls).select(F.col("ord").alias("ball"), *[F.col(f"c_{x}").alias(f"m_{x}") for x in LETTERS])
    dot = lambda a, b: _dot([F.col(f"{a}_{x}") for x in LETTERS], [F.col(f"{b}_{x}") for x in LETTERS])
    # As many centres as the root of a catalogue that was counted.
    own = units.crossJoin(F.broadcast(centres)).groupBy("ord").agg(F.max_by(F.struct("ball", dot("c", "m").alias("to")), F.struct(dot("c", "m").alias("d"), "ball")).alias("x"))
    placed = settle(units.join(own.hint("merge"), "ord").select("ord", "carrera", "x.ball", "x.to", *[f"c_{x}" for x in LETTERS]), "placed")
    angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    sized = settle(centres.join(placed.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), angle(F.min("to")).alias("radius")).hint("merge"), "ball"), "balls")
    p = with_unit(profiles, "p_").select(key, *[f"p_{x}" for x in LETTERS])
    met = settle(p.crossJoin(F.broadcast(sized)).select(key, *[f"p_{x}" for x in LETTERS], "ball", "n", dot("p", "m").alias("to"), F.cos(F.greatest(F.lit(0.0), angle(dot("p", "m")) - F.col("radius"))).alias("most")), "met")
    order = Window.partitionBy(key).orderBy(F.col("afinidad").desc(), "ord")

    def ranked(pairs: DataFrame) -> DataFrame:
        entries = pairs.join(small(placed.drop("to")), "ball").select(key, "ord", "carrera", F.round(dot("p", "c"), digits).alias("afinidad"))
        return entries.withColumn("lugar", F.row_number().over(order)).where(F.col("lugar") <= k)

    full = F.when(F.col("n") >= k, F.struct("to", "ball"))
    near = met.where(F.col("n") >= k).groupBy(key).agg(F.max(full).alias("x")).select(key, F.col("x.ball").alias("ball"))
    bound = settle(ranked(met.join(near.hint("merge"), [key, "ball"])).where(F.col("lugar") == k).select(key, F.col("afinidad").alias("least")), "bounds")
    reach = met.join(bound.hint("merge"), key, "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - 2 * 10.0**-digits))
    return ranked(reach).select(key, "lugar", "ord", "carrera", "afinidad")


def unmatched(requests: DataFrame, matches: DataFrame, profiles: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """form_id, texto without a match of 0.30, mensaje, and `alternativas`: carrera and afinidad of the k entries nearest to the profile. Only profiles of such forms are compared."""
    asked = requests.where(F.trim("texto") != "").withColumn("q", normalize("texto"))
    lost = settle(asked.join(matches.where(F.col("score") >= LEAST_MATCH).select("q").distinct(), "q", "left_anti").select("form_id", "texto"), "lost")
    top = nearest_entries(profiles.join(lost.select("form_id").distinct(), "form_id", "left_semi"), catalog, k)
    listed = F.array_sort(F.collect_list(F.struct("lugar", "carrera", "afinidad")))
    alternatives = top.groupBy("form_id").agg(F.transform(listed, lambda x: F.struct(x["carrera"].alias("carrera"), x["afinidad"].alias("afinidad"))).alias("alternativas"))
    return lost.join(alternatives.hint("merge"), "form_id", "left").select("form_id", "texto", F.format_string(NOT_FOUND, "texto").alias("mensaje"), "alternativas")


def explain(profiles: DataFrame, recommended: DataFrame, coherences: DataFrame) -> DataFrame:
    """form_id, razonamiento: the two leading areas, the best and the second entry, an alert, and how coherent the entries are."""
    names = F.create_map(*[F.lit(x) for pair in AREAS.items() for x in pair])
    order = F.array_sort(F.array(*[F.struct((-F.col(x)).alias("neg"), F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(LETTERS)]))
    pick = lambda i, c: F.max(F.when(F.col("lugar") == i, F.col(c)))
    r = recommended.groupBy("form_id").agg(*[pick(i, c).alias(f"{c}{i}") for i in (1, 2) for c in ("carrera", "afinidad", "match")])
    j = profiles.join(r, "form_id", "left").join(coherences, "form_id", "left").withColumn("o", order)
    # format_number rounds the binary value half to even; format_string would round its shortest decimal half up.
    number = lambda c: F.format_number(c, 2)
    area = lambda i: [F.element_at(names, F.get("o", F.lit(i))["x"]), number(-F.get("o", F.lit(i))["neg"])]
    say = lambda name, *values: F.format_string(SENTENCES[name].replace("%.2f", "%s"), *values)
    parts = [
        say("areas", *area(0), *area(1)),
        say("first", F.col("carrera1"), number(F.col("afinidad1")), number(F.col("match1"))),
        F.when(F.col("carrera2").isNotNull(), say("second", F.col("carrera2"), number(F.col("afinidad2")))),
        F.when(F.col("afinidad1") < TRUSTED, F.lit(SENTENCES["alert"])),
        F.when(F.col("coherencia") < INCOHERENT, say("apart", number(F.col("coherencia")))).when(F.col("coherencia") > COHERENT, say("together", number(F.col("coherencia")))),
    ]
    return j.select("form_id", F.when(F.col("carrera1").isNull(), F.lit(SENTENCES["none"])).otherwise(F.concat_ws(" ", *parts)).alias("razonamiento"))


def empty_requests(forms: DataFrame, requests: DataFrame) -> DataFrame:
    """Forms without a text that isn't blank, with a message and zero coherence."""
    asked = requests.where(F.trim("texto") != "").select("form_id").distinct()
    return forms.select("form_id").join(asked, "form_id", "left_anti").select("form_id", F.lit(0.0).alias("coherencia"), F.lit("No ingresaste ninguna carrera para evaluar.").alias("mensaje"))


def recommend_once(requests: DataFrame, profiles: DataFrame, matches: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """The rows of recommend(), computed once for all forms that ask for the same with the same profile.

    A request is a form's profile and the set of its texts and wishes; the form with the smallest id stands for all that share it.
    """
    wishes = F.sort_array(F.collect_set(F.struct("texto", "nivel", "institucion"))).alias("asked")
    whole = requests.groupBy("form_id").agg(wishes).join(profiles.select("form_id", *LETTERS), "form_id")
    keyed = whole.select("form_id", F.sha2(F.to_json(F.struct("asked", *LETTERS), {"ignoreNullFields": "false"}), 256).alias("key"))
    shared = settle(keyed.withColumn("first", F.min("form_id").over(Window.partitionBy("key"))).select("form_id", "first"), "requests")
    first = shared.where("form_id = first").select("form_id")
    done = settle(recommend(requests.join(first, "form_id", "left_semi"), profiles.join(first, "form_id", "left_semi"), matches, catalog, k), "recommended")
    return shared.join(done.withColumnRenamed("form_id", "first").hint("merge"), "first").drop("first").select("form_id", *[c for c in done.columns if c != "form_id"])


def dedupe_requests(requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct requests with a `request_key`, and which form has which: work done once is joined back on the key."""
    key = F.sha2(F.to_json(F.struct(*keys)), 256)
    keyed = requests.withColumn("request_key", key)
    return keyed.select("request_key", *keys).distinct(), keyed.select("form_id", "request_key")


def interpret(recommended: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per form the best recommended entry with a match of 0.30 in the main catalogue, with match, afinidad, score and the text it came from, and the rest with theirs as alternativas. canonical: texto (the entry's name), carrera."""
    names = canonical.where("carrera IS NOT NULL").select(F.col("texto").alias("nombre"), F.col("carrera").alias("oficial"))
    j = recommended.withColumnRenamed("carrera", "nombre").where(F.col("match") >= LEAST_MATCH).join(names.hint("merge"), "nombre")
    g = j.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct("lugar", "oficial", "match", "afinidad", "score", "texto"))).alias("v"))
    first = F.get("v", F.lit(0))
    shown = ("match", "afinidad", "score")
    rest = F.transform(F.slice("v", F.lit(2), F.size("v")), lambda x: F.struct(x["oficial"].alias("carrera"), *[x[c].alias(c) for c in shown]))
    return g.select("form_id", first["oficial"].alias("carrera"), *[first[c].alias(c) for c in shown], first["texto"].alias("texto_original"), rest.alias("alternativas"))
