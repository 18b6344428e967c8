"""Similarity tiers against difflib over all pairs."""

import difflib

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import affinity, recommend

NAMES = ["Medicina Humana", "Derecho", "Ingeniería Civil", "Mecánica Automotriz", "Arte", "Economía", "Educación"]
TEXTS = ["medisina umana", "derexo", "DERECHO", " ing civil ", "mecanica automotris", "artes", "xyz", "", "ekonomia", "educasion", "Educacion fisica"]


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_closest_name(spark):
    careers = spark.createDataFrame([(n,) for n in NAMES], "carrera string")
    got = {r.texto: r.carrera for r in affinity.closest_name(spark.createDataFrame([(t,) for t in TEXTS], "texto string"), careers).collect()}
    want = {}
    for t in {t.strip() for t in TEXTS} - {""}:
        same = [n for n in NAMES if n.lower() == t.lower()]
        near = difflib.get_close_matches(t, NAMES, n=1, cutoff=0.62)
        want[t] = same[0] if same else near[0] if near else None
    assert got == want


def test_fuzzy_search(spark):
    catalog = spark.createDataFrame([(i, n, [n[:4] + "x"], [n.split()[0].lower()]) for i, n in enumerate(NAMES)], "ord int, carrera string, alias array<string>, keywords array<string>")
    norm = {r.x: r.y for r in spark.createDataFrame([(x,) for n in NAMES for x in (n, n[:4] + "x", n.split()[0].lower())] + [(t,) for t in TEXTS], "x string").select("x", T.normalize("x").alias("y")).collect()}
    texts = spark.createDataFrame([(norm[t], i) for t in TEXTS if norm[t] for i in range(len(NAMES))], "q string, ord int").distinct()
    got = {(r.q, r.ord): round(r.score, 9) for r in recommend.search_fuzzy(texts, catalog).collect()}
    want = {}
    for t in {norm[t] for t in TEXTS} - {""}:
        for i, n in enumerate(NAMES):
            best = max(ratio(t, norm[x]) for x in (n, n[:4] + "x", n.split()[0].lower()))
            if best >= 0.78:
                want[t, i] = round(best * 0.9, 9)
    assert got == want and want


def test_search_falls_through_to_similarity(spark):
    catalog = spark.createDataFrame([(i, n, [], [n.split()[0]]) for i, n in enumerate(NAMES)], "ord int, carrera string, alias array<string>, keywords array<string>")
    none = spark.createDataFrame([], "token string, expansion string")
    found = recommend.search(spark.createDataFrame([(t,) for t in TEXTS], "texto string"), recommend.search_index(catalog), none, catalog, 1)
    got = {r.q: (r.ord, r.nivel) for r in found.collect()}
    assert got["derecho"] == (1, 1) and got["educasion"] == (6, 3) and got["mecanica automotris"] == (3, 2) and got["ekonomia"] == (5, 3)
    assert not {"xyz", "", "derexo"} & set(got)  # the last reaches 0.77 only


def test_edit_ratio(spark):
    df = spark.createDataFrame([("casa", "caso"), ("", ""), ("abc", "")], "a string, b string")
    assert [r[0] for r in df.select(F.round(T.edit_ratio("a", "b"), 6)).collect()] == [0.75, 1.0, 0.0]


def test_no_pair_is_lost(spark):
    import random

    rng = random.Random(7)
    word = lambda a, b: "".join(rng.choice("abcdeé ñX1") for _ in range(rng.randint(a, b))).strip() or "a"
    names = [word(1, 14) for _ in range(80)]
    texts = [word(1, 14) for _ in range(80)] + ["".join(c for c in n if rng.random() > 0.1) for n in names]
    for cutoff, swapped in ((0.62, True), (0.72, False), (0.78, False)):
        df = T.alike(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string"), cutoff, swapped)
        want = {(t, n, round(s, 9)) for t in texts if t for n in names if (s := ratio(n, t) if swapped else ratio(t, n)) >= cutoff}
        assert {(r.text, r.name, round(r.sim, 9)) for r in df.collect()} == want and want


def test_aliases_stop_at_the_first_near_one(spark):
    catalog = spark.createDataFrame([(1, "otra cosa", ["medicinal", "medicina"], []), (2, "otra cosa", ["medicina", "medicinal"], []), (3, "medicinal", ["medicinas", "medicina"], []), (4, "x", ["medicinal"], ["medicina"])], "ord int, carrera string, alias array<string>, keywords array<string>")
    got = {r.ord: round(r.score / 0.9, 6) for r in recommend.search_fuzzy(spark.createDataFrame([("medicina", i) for i in range(1, 5)], "q string, ord int"), catalog).collect()}
    near = round(ratio("medicina", "medicinal"), 6)
    # 1: the first alias is near enough, the exact one behind it isn't read; 3: no alias before the exact one is nearer than the name; 4: keywords are read anyway.
    assert near >= 0.85 and got == {1: near, 2: 1.0, 3: 1.0, 4: 1.0}


def misspelled(seed, count):
    """Names of one to three words, and texts: misspelled names and others."""
    import random

    rng = random.Random(seed)
    syllable = lambda: rng.choice("bcdfghjlmnpqrstvz") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "l"])
    words = ["".join(syllable() for _ in range(rng.randint(2, 4))) for _ in range(1500)]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    names, texts = list({name() for _ in range(count)}), set()
    for _ in range(count):
        text = list(rng.choice(names) if rng.random() < 0.5 else name())
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        texts.add("".join(text))
    return names, list(texts)


def test_candidates_are_a_small_part_of_fitting_lengths(spark):
    from collections import Counter

    names, texts = misspelled(5, 5000)
    frames = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string")
    of_texts, of_names = Counter(map(len, texts)), Counter(map(len, names))
    for cutoff in (0.72, 0.78, 0.85):
        fitting = sum(x * y for a, x in of_texts.items() for b, y in of_names.items() if 2 * min(a, b) >= cutoff * (a + b))
        met = T.candidates(*frames, cutoff)
        assert 0 < met.count() < 0.05 * fitting
    plan = T.candidates(*frames, 0.72)._jdf.queryExecution().executedPlan().toString()
    assert "bit_count" in plan[plan.index("Join") : plan.index("Join") + 2000] and "Cartesian" not in plan and "NestedLoop" not in plan


def test_candidates_lose_no_pair(spark):
    names, texts = misspelled(9, 150)
    names += ["a" * 30, "é" * 12, "Ab Cd 12", "aaaaaaaaa bb"]
    texts += ["a" * 26, "éé" * 5 + "e", "ab cd 12", "aaaaaaaaaaa b", "ñandú"]
    frames = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string")
    for cutoff in (0.5, 0.62, 0.72, 0.9):
        got = {(r.text, r.name) for r in T.candidates(*frames, cutoff).collect()}
        assert {(t, n) for t in texts for n in names if ratio(t, n) >= cutoff} <= got
