"""Small tables with known answers, and properties that must hold for any input."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import affinity, classify, layout, marks, monitor, proposal, recommend, scoring
from tallyforge.sources import ingest, storage

# ---- scoring


def test_raw_scores_by_block(spark):
    hit = ["E1", "E2", "P3", "P6", "H1", "H2", "H4", "H5", "H8"]
    other = ["E4", "P9", "H9"]
    items = spark.createDataFrame([("T", 0, x[0], int(x[1:]), x) for x in hit + other] + [("U", 1, "P", 40, "P40")], "tipo string, tipo_ord int, bloque string, num int, item string")
    answers = spark.createDataFrame([(1, x, " SI " if x != "E2" else "ambos") for x in hit] + [(1, x, "no") for x in other], "form_id long, item string, opcion string")
    forms = spark.createDataFrame([(1,), (2,)], "form_id long")
    got = {(r.form_id, r.tipo): (r.pd_e, r.pd_p, r.pd_h, r.pd) for r in scoring.raw_scores(answers, items, forms).collect()}
    assert got == {(1, "T"): (2, 2, 5, 9), (1, "U"): (0, 0, 0, 0), (2, "T"): (0, 0, 0, 0), (2, "U"): (0, 0, 0, 0)}


def test_norms_by_group_and_missing(spark):
    norms = spark.createDataFrame([("F", "A", 6, 40), ("F", "B", 8, 60), ("M", "A", 6, 42), ("M", "B", 8, 50)], "sexo string, tipo string, pd long, baremo int")
    scores = spark.createDataFrame([(1, "F", "A", 6), (1, "F", "B", 8), (2, "M", "A", 6), (2, "M", "B", 8), (3, "?", "A", 6), (3, None, "B", 99)], "form_id long, sexo string, tipo string, pd long")
    got = {(r.form_id, r.tipo): r.baremo for r in scoring.norm_scores(scores, norms).collect()}
    assert got == {(1, "A"): 40, (1, "B"): 60, (2, "A"): 42, (2, "B"): 50, (3, "A"): 42, (3, "B"): None}


def test_ranking_and_top_two(spark):
    rows = [(1, f"T{i}", i, pd, b) for i, (b, pd) in enumerate(zip([42, 50, 44, 52, 34, 42, 31], [6, 8, 6, 11, 2, 9, 0], strict=True))]
    df = spark.createDataFrame(rows + [(2, "T0", 0, 1, None), (2, "T1", 1, 1, 0)], "form_id long, tipo string, tipo_ord int, pd long, baremo int")
    ranked = scoring.rank_types(df)
    top = {r.form_id: (r.tipo1, r.tipo2) for r in scoring.top_types(ranked).collect()}
    assert top == {1: ("T3", "T1"), 2: ("T1", "T0")}
    for form, n in ((1, 7), (2, 2)):
        assert sorted(r.posicion for r in ranked.where(f"form_id = {form}").collect()) == list(range(1, n + 1))


@pytest.mark.parametrize(("value", "expected"), [(None, "sin_dato"), (0, "bajo"), (39, "bajo"), (40, "medio"), (60, "medio"), (61, "alto"), (99, "alto")])
def test_levels(spark, value, expected):
    df = spark.createDataFrame([(value,)], "baremo int")
    assert scoring.with_level(df).first().nivel == expected


def test_relative_level_of_empty_maximum(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 10), (2, 8), (2, 5), (2, 4)], "form_id long, pd long")
    assert sorted(r.relativo for r in scoring.relative_level(df).where("form_id = 2").collect()) == ["alto", "alto", "bajo", "medio"]
    assert {r.relativo for r in scoring.relative_level(df).where("form_id = 1").collect()} == {"sin_dato"}


def test_profile_without_data_is_zero(spark):
    df = spark.createDataFrame([(1, "X", None), (1, "Y", 99), (1, "Z", 120)], "form_id long, tipo string, baremo int")
    letters = spark.createDataFrame([("X", "r"), ("Y", "i"), ("Z", "a")], "tipo string, letra string")
    r = scoring.profile_from_norms(df, letters).first()
    assert (r.r, r.i, r.a, r.s, r.e, r.c) == (0.0, 1.0, 1.0, 0.0, 0.0, 0.0)


# ---- marks


def test_empty_form_has_118_empties(spark):
    items = marks.item_dim(spark)
    forms = spark.createDataFrame([(1,)], "form_id long")
    none = spark.createDataFrame([], "form_id long, item string, opcion string")
    full = marks.complete_marks(none, forms, items)
    r = marks.audit_marks(full).first()
    assert (r.total, r.n_vacio, len(r.vacios), len(r.dudosos), r.n_si) == (118, 118, 118, 118, 0)


@pytest.mark.parametrize(("label", "item"), [("EI", "E1"), ("1E", "E1"), (" 12 p ", "P12"), ("hl2", "H12"), ("P47", "P47"), ("E99", "E99"), ("", "")])
def test_label_repair(spark, label, item):
    assert marks.repair_labels(spark.createDataFrame([(label,)], "label string")).first()["item"] == item


@pytest.mark.parametrize(("name", "problem"), [(None, "vacio"), (" ", "vacio"), ("a", "corto"), ("x" * 51, "largo"), ("Ana-María d'Alba", None), ("-Ana", "caracteres"), ("Ana--Luz", "caracteres"), ("R2", "caracteres")])
def test_name_problems(spark, name, problem):
    assert marks.validate_names(spark.createDataFrame([(name,)], "n string"), ["n"]).first().n_problema == problem


# ---- files


@pytest.mark.parametrize(
    ("path", "content", "kind"),
    [("a.pdf", b"", "pdf"), ("a.JPG", b"", "imagen"), ("a", b"%PDF-1", "pdf"), ("a.bin", b"\xff\xd8\xff\x00", "imagen"), ("a", b"MM\x00*", "imagen"), ("a", b"RIFF....WEBP", "imagen"), ("a", b"RIFF....WAVE", "desconocido"), ("a", None, "desconocido")],
)
def test_file_types(spark, path, content, kind):
    assert ingest.sniff_type(spark.createDataFrame([(path, content)], "path string, content binary")).first().tipo == kind


def test_scan_and_failure_isolation(spark, tmp_path):
    for name in ("ana-rozas_16_F.pdf", "bad.pdf", "luis_perez_15_m.pdf"):
        (tmp_path / name).write_bytes(b"%PDF")
    files = ingest.scan_files(spark, str(tmp_path))
    parsed = ingest.parse_form_name(files.select("name"))
    assert {r.nombre: (r.edad, r.sexo) for r in parsed.where("valid").collect()} == {"Ana Rozas": (16, "F"), "Luis Perez": (15, "M")}

    def work(row):
        if row["name"].startswith("bad"):
            raise ValueError("no document")
        return {"name": row["name"], "n": 118}

    out = ingest.run_batch(files.select("name"), work, "name string, n long")
    assert [(r.n, r.error) for r in out.where("NOT ok").collect()] == [(None, "no document")]
    assert tuple(ingest.batch_counts(out).first()) == (3, 2, 1)
    good, bad = ingest.split_valid(parsed, "batch")
    assert (good.count(), bad.count()) == (0, 3)


def test_catalog_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"carreras": {"A": ["x", "y"]}, "grupos": [{"id": "g", "nombre": "G", "carreras": ["x"]}], "palabras_clave": {"x": ["k"]}, "reglas": [{"carreras": ["x", "y"], "razon": "r"}, {"carreras": ["x"]}], "tipos_relacionados": {"A": ["B"]}}')
    flat = ingest.load_affinity(spark, str(tmp_path / "a.json"))
    assert [(r.tipo, r.ord, r.carrera) for r in flat["types"].orderBy("ord").collect()] == [("A", 1, "x"), ("A", 2, "y")]
    assert flat["rules"].count() == 1 and tuple(flat["weights"].first()) == (5, 3, 1, 2)
    (tmp_path / "b.json").write_text('{"version": 2, "carreras": [{"nombre": "n", "nivel": "tecnico", "institucion": ["a", "b"]}, {"nombre": "m", "perfil_riasec": [1, 0, 0, 0, 0, 0.5], "keywords": ["k"]}]}')
    got = {r.ord: (r.nombre, r.nivel, r.institucion, r.perfil, r.keywords) for r in ingest.load_catalog(spark, str(tmp_path / "b.json")).collect()}
    assert got == {1: ("n", ["tecnico"], ["a", "b"], [0.0] * 6, []), 2: ("m", [], [], [1.0, 0.0, 0.0, 0.0, 0.0, 0.5], ["k"])}


# ---- classification


def _signals(spark, rows):
    return spark.createDataFrame(rows, "form_id long, bloque string, num int, dens_no double, dens_si double, centro_no double, centro_si double, stroke_no double, stroke_si double, dt_no double, dt_si double, sym_no double, sym_si double")


def test_vote_is_symmetric(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(300):
        v = [rng.choice([0.0, 0.004, 0.006, 0.03, 0.1, 0.3]) for _ in range(4)] + [rng.choice([0.0, 0.05, 0.2, 0.6]) for _ in range(6)]
        rows.append((1, "E", i, *v))
    s = _signals(spark, rows).withColumn("umbral", F.lit(0.005))
    flip = s.selectExpr("form_id", "bloque", "num", *[f"{c}_{a} AS {c}_{b}" for c in ("dens", "centro", "stroke", "dt", "sym") for a, b in (("no", "si"), ("si", "no"))], "umbral")
    a = {r.num: r.opcion for r in classify.classify_vote(s).collect()}
    b = {r.num: r.opcion for r in classify.classify_vote(flip).collect()}
    swap = {"si": "no", "no": "si", "ambos": "ambos", "vacio": "vacio"}
    assert {k: swap[v] for k, v in a.items()} == b and len(set(a.values())) == 4


def test_swap_of_first_rows(spark):
    row = lambda n, no, si: (1, "E", n, no, si, no, si, 0.5, 0.5, 0.5, 0.5, 1.0, 1.0)
    rows = [row(1, 0.0, 0.08), row(2, 0.08, 0.0)] + [row(n, 0.08, 0.0) for n in range(3, 9)]
    assert [r.num for r in classify.flag(_signals(spark, rows), "swap").where("swap").orderBy("num").collect()] == [1, 2]
    assert classify.flag(_signals(spark, rows[1:]), "swap").where("swap").count() == 0


def test_outcome_states(spark):
    rows = [(f, f"E{i}", "si", False) for f, n in ((1, 118), (2, 110), (3, 50)) for i in range(n)]
    got = {r.form_id: r.estado for r in classify.form_outcome(spark.createDataFrame(rows, "form_id long, item string, opcion string, revisar boolean")).collect()}
    assert got == {1: "ok", 2: "warn", 3: "fail"}


# ---- layout


def test_cluster_and_intervals(spark):
    cuts = spark.createDataFrame([(1, x) for x in (0, 2, 5, 30, 31, 60, 90, 100)], "page_id long, pos int")
    merged = layout.cluster_coords(cuts, 5, ["page_id"])
    assert sorted(r.pos for r in merged.collect()) == [2, 30, 60, 90, 100]
    assert [(r.y1, r.y2) for r in layout.cuts_to_intervals(merged, ["page_id"]).orderBy("fila").collect()] == [(2, 30), (30, 60), (60, 90), (90, 100)]


def test_missing_cut_needs_a_solid_line(spark):
    cuts = spark.createDataFrame([(p, y) for p in (1, 2) for y in (0, 20, 40, 80, 100)], "page_id long, pos int")
    line = [(1, 60, x) for x in range(30)] + [(2, 60, x) for x in range(5)] + [(p, 45, 0) for p in (1, 2)]
    px = spark.createDataFrame(line, "page_id long, y int, x int").withColumn("w", F.lit(50))
    lines = storage.settle(layout.line_runs(px, ["page_id"]), "lines")
    assert {(r.page_id, r.y): [tuple(x) for x in r.runs] for r in lines.collect()} == {(1, 60): [(0, 30)], (2, 60): [(0, 5)], (1, 45): [(0, 1)], (2, 45): [(0, 1)]}
    got = layout.insert_missing_cuts(cuts, lines, ["page_id"])
    assert sorted(r.pos for r in got.where("page_id = 1").collect()) == [0, 20, 40, 60, 80, 100]
    assert got.where("page_id = 2").count() == 5


def test_small_cells_give_zeros(spark):
    px = layout.pack_cells(spark.createDataFrame([(1, y, x, 1, 0) for y in range(3) for x in range(3)], "cell_id long, y int, x int, ink int, gray int"))
    assert layout.ink_features(px).first().dens_total == 0.0 and layout.quadrant_symmetry(px).first().simetria == 0.0
    assert layout.gray_variance(px).first().varianza == 0.0 and layout.border_dark_share(px).first().oscuro == 0.0


def test_packed_cells_measure_what_their_pixels_do(spark):
    """Cells of any size, with missing pixels and short last rows, against the definitions pixel by pixel."""
    import math
    import random

    rng, rows, want = random.Random(4), [], {}
    for cell, (h, w, gaps) in enumerate([(1, 1, 0), (4, 4, 0), (5, 9, 0.2), (8, 12, 0), (16, 24, 0.1), (9, 40, 0), (30, 13, 0.3), (60, 55, 0.05), (51, 70, 0), (8, 11, 0)]):
        px = {(y, x): (int(rng.random() < 0.3), rng.randrange(256)) for y in range(h) for x in range(w) if rng.random() >= gaps or (y, x) == (h - 1, w - 1)}
        rows += [(cell, y, x, *v) for (y, x), v in px.items()]

        def share(where, flag=lambda v: v[0], px=px):
            hit = [flag(v) for at, v in px.items() if where(*at)]
            return sum(hit) / len(hit) if hit else 0.0

        def margin(side, part):
            return max(1, int(side * part))

        py, pw = margin(h, 0.1), margin(w, 0.1)
        inside = lambda y, x, h=h, w=w, py=py, pw=pw: py <= y < h - py and pw <= x < w - pw
        ih, iw = h - 2 * py, w - 2 * pw
        big = h >= 8 and w >= 12
        centre = lambda y, x: inside(y, x) and int(ih * 0.2) <= y - py < int(ih * 0.8) and int(iw * 0.2) <= x - pw < int(iw * 0.8)  # noqa: B023, E731
        left = lambda y, x: inside(y, x) and x - pw < max(1, iw // 5)  # noqa: B023, E731
        right = lambda y, x: inside(y, x) and x - pw >= min(iw - 1, 4 * iw // 5)  # noqa: B023, E731
        features = [share(f) if big else 0.0 for f in (inside, centre, left, right)]
        halves = [share(lambda y, x, s=s: inside(y, x) and (x - pw < iw // 2) == s) if big else 0.0 for s in (True, False)]  # noqa: B023
        symmetry = sum(share(lambda y, x, a=a, b=b: (y < h // 2) == a and (x < w // 2) == b) >= 0.01 for a in (True, False) for b in (True, False)) / 4 if h >= 4 and w >= 4 else 0.0  # noqa: B023
        gy, gw = margin(h, 0.15), margin(w, 0.15)
        grays = [v[1] for (y, x), v in px.items() if gy <= y < h - gy and gw <= x < w - gw]
        n = len(grays)
        variance = min(1.0, (n * sum(g * g for g in grays) - sum(grays) ** 2) / (n * n) / 2000) if h >= 5 and w >= 5 and n else 0.0
        bh, bw = max(2, int(h * 0.03)), max(2, int(w * 0.03))
        border = [v[1] < 128 for (y, x), v in px.items() for hit in (y < bh, y >= h - bh, x < bw, x >= w - bw) if hit]
        dark = sum(border) / len(border) if h >= 10 and w >= 10 else 0.0
        want[cell] = [*features, *halves, symmetry, variance, dark]
    cells = storage.settle(layout.pack_cells(spark.createDataFrame(rows, "cell_id long, y int, x int, ink int, gray int").repartition(5)), "cells")
    tables = [layout.ink_features(cells).drop("marcada"), layout.half_density(cells).toDF("cell_id", "a", "b"), layout.quadrant_symmetry(cells), layout.gray_variance(cells), layout.border_dark_share(cells, least_side=10).drop("foto")]
    got = {cell: [x for t in tables for r in t.where(F.col("cell_id") == cell).collect() for x in r[1:]] for cell in want}
    for cell, values in want.items():
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got[cell], values, strict=True)), cell
    for t in tables:
        plan = _plan(t)
        assert "Exchange" not in plan and "Window" not in plan and "Generate" not in plan


def test_runs_of_rows(spark):
    rows = ["", "0", "1", "0110", "1011", "1 1", "0" * 9, "111"]
    got = {r.t: [tuple(x) for x in r.r] for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", layout.runs("t").alias("r")).collect()}
    assert got == {"": [], "0": [], "1": [(0, 1)], "0110": [(1, 3)], "1011": [(0, 1), (2, 4)], "1 1": [(0, 1), (2, 3)], "0" * 9: [], "111": [(0, 3)]}


# ---- catalogue


@pytest.fixture(scope="module")
def catalog(spark):
    careers = spark.createDataFrame([("Ingeniería Civil",), ("Derecho",), ("Medicina Humana",)], "carrera string")
    aliases = spark.createDataFrame([("abogado", "Derecho"), ("casa", "Ingeniería Civil")], "alias string, carrera string")
    keywords = spark.createDataFrame([("Derecho", "leyes"), ("Medicina Humana", "salud"), ("Derecho", "salud")], "carrera string, palabra string")
    return careers, aliases, keywords


@pytest.mark.parametrize(
    ("text", "carrera", "step"),
    [("ABOGADO", "Derecho", 1), ("casas", "Ingeniería Civil", 2), ("abogados ", "Derecho", 2), ("derecho", "Derecho", 3), ("ingenieria civil", "Ingeniería Civil", 3), ("Leyes", "Derecho", 4), ("salud", "Derecho", 4), ("la medicina", "Medicina Humana", 5), ("medisina humana", "Medicina Humana", 5), ("derexho", "Derecho", 6)],
)
def test_resolution_tiers(spark, catalog, text, carrera, step):
    r = affinity.resolve_names(spark.createDataFrame([(text,)], "texto string"), *catalog).collect()
    assert [(x.carrera, x.paso) for x in r] == [(carrera, step)]


def test_unknown_and_blank_texts_resolve_to_nothing(spark, catalog):
    assert affinity.resolve_names(spark.createDataFrame([("zzz qqq",), ("",), (None,), ("xy",)], "texto string"), *catalog).count() == 0


def test_normalization_ignores_case_and_accents(spark):
    words = ["Ingeniería Civil", "ÑANDÚ, veloz!", "  a-b  c ", "Über/çelik"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    plain = lambda c: [r[0] for r in df.select(T.normalize(c)).collect()]
    assert plain(F.col("t")) == plain(F.upper("t")) == plain(F.lower("t")) == ["ingenieria civil", "nandu veloz", "a b c", "uber celik"]


def test_best_two_pairs_are_disjoint(spark):
    rows = [("A", "B", f"a{i}", f"b{j}", i, j, (i * 3 + j * 5) % 7, "x") for i in range(4) for j in range(4)]
    got = affinity.best_two_pairs(spark.createDataFrame(rows, "tipo_a string, tipo_b string, a string, b string, ord_a int, ord_b int, puntaje int, relacion string")).orderBy("rango").collect()
    assert [r.rango for r in got] == [1, 2] and got[0].puntaje == 6
    assert not {got[0].a, got[0].b} & {got[1].a, got[1].b}


def test_leading_pairs_hold_the_best_two(spark):
    """Against all pairs: shared and lone features, entries of two types, rules, wide entries, ties."""
    import random

    for seed, widest in ((1, 10), (2, 10), (3, 2), (4, 0)):
        rng = random.Random(seed)
        names = [f"c{i:02d}" for i in range(60)]
        types = {n: rng.sample(["A", "B", "C", "D"], rng.choice([1, 1, 2])) for n in names}
        numbers = {t: 0 for t in "ABCD"}
        rows = []
        for n in rng.sample(names, len(names)):
            for t in types[n]:
                numbers[t] += 1
                rows.append((t, n, numbers[t]))
        career_types = spark.createDataFrame(rows, "tipo string, carrera string, ord int")
        few = lambda k, n: rng.sample([f"{k}{i}" for i in range(n)], rng.randint(0, 3))  # noqa: B023, E731
        sets = storage.settle(spark.createDataFrame([(n, sorted(few("g", 5)), sorted(few("k", 9))) for n in names], "carrera string, grupos array<string>, palabras array<string>"), "sets")
        rules = spark.createDataFrame([(*rng.sample(names, 2), f"r{i}") for i in range(rng.choice([0, 12]))], "a string, b string, razon string").dropDuplicates(["a", "b"])
        related = spark.createDataFrame([("A", "C"), ("B", "A")], "tipo string, rel string")
        every = storage.settle(affinity.pair_affinity(affinity.type_pairs(career_types), sets, rules, related), "every")
        lead = storage.settle(affinity.pair_affinity(affinity.leading_pairs(career_types, sets, rules, widest=widest), sets, rules, related), "lead")
        assert lead.exceptAll(every).count() == 0 and lead.count() < every.count()
        best = [sorted(map(tuple, affinity.best_two_pairs(x).collect())) for x in (every, lead)]
        assert best[0] == best[1] and len(best[0]) == 24


def test_leading_pairs_grow_with_the_lists(spark):
    """Four times the entries give four times the rows, not sixteen."""
    rows = []
    for n in (300, 1200):
        career_types = spark.createDataFrame([(f"T{i % 3}", f"c{i}", i) for i in range(n)], "tipo string, carrera string, ord int")
        sets = storage.settle(spark.createDataFrame([(f"c{i}", [f"g{i % 5}"], ["hot", f"k{i // 6}"]) for i in range(n)], "carrera string, grupos array<string>, palabras array<string>"), "sets")
        rules = spark.createDataFrame([(f"c{i}", f"c{i + 1}", "r") for i in range(0, n - 1, 10)], "a string, b string, razon string")
        rows.append(affinity.leading_pairs(career_types, sets, rules).count())
    assert rows[1] < 5 * rows[0] and rows[1] < 0.05 * 1200 * 800


def test_every_accent_goes_under_strip(spark):
    words = {"Őr ǎ Š ﬁn ½": "or a s fin 1 2", "Ñandú É": "nandu e", "e\u0301x": "ex", "ＡＢ": "ab"}
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert {r.t: r.s for r in df.select("t", T.normalize("t", "strip").alias("s")).collect()} == words


def test_files_are_scanned(spark, tmp_path):
    for name, data in (("a_11_F.pdf", b"%PDF-1.4"), ("b.jpg", b"\xff\xd8\xff"), ("c.txt", b"x" * 1000)):
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.length, bytes(r.content)) for r in ingest.scan_files(spark, str(tmp_path)).collect()}
    assert got == {p.name: (p.stat().st_size, p.read_bytes()) for p in tmp_path.iterdir()}
    assert [r.name for r in ingest.scan_files(spark, str(tmp_path), "*.pdf").collect()] == ["a_11_F.pdf"]


def test_proposals_that_no_name_resolves(spark):
    written = spark.createDataFrame([(1, 1, " Derecho "), (1, 2, "leyes"), (1, 3, "zzz"), (1, 4, " "), (2, 1, None), (1, 5, "derecho")], "form_id long, ord int, texto string")
    named = spark.createDataFrame([("Derecho", "Derecho"), ("leyes", None), ("zzz", None), ("derecho", "Derecho")], "texto string, carrera string")
    free = spark.createDataFrame([(1, 2, "Derecho", 0.9, 0.8, 0.7, ["Arte"]), (1, 1, "Arte", 0.9, 0.8, 0.7, [])], "form_id long, ord int, carrera string, match double, afinidad double, score double, alternativas array<string>")
    r = proposal.resolve_proposals(written, named, free)
    got = {x.ord: (x.texto, x.origen, x.carrera, x.match) for x in r.collect()}
    assert got == {1: ("Derecho", "nombre", "Derecho", None), 2: ("leyes", "interpretada", "Derecho", 0.9), 3: ("zzz", "no_encontrada", None, None), 5: ("derecho", "nombre", "Derecho", None)}
    assert [tuple(x) for x in proposal.proposed_entries(r).collect()] == [(1, "Derecho", 1)]


# ---- recommendation and proposals


def test_cosine_is_bounded(spark):
    import random

    rng = random.Random(1)
    rows = lambda n: [(i, *[rng.random() if i else 0.0 for _ in range(6)]) for i in range(n)]
    letters = ", ".join(f"{x} double" for x in recommend.LETTERS)
    got = recommend.cosine_affinity(spark.createDataFrame(rows(20), f"form_id long, {letters}"), spark.createDataFrame(rows(10), f"ord int, {letters}")).collect()
    assert len(got) == 200 and all(-1e-9 <= r.afinidad <= 1 + 1e-9 for r in got)
    assert {r.afinidad for r in got if r.form_id == 0 or r.ord == 0} == {0.0}


def test_explanations(spark):
    profiles = spark.createDataFrame([(1, 0.9, 0.1, 0.0, 0.3, 0.3, 0.2), (2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1)], "form_id long, r double, i double, a double, s double, e double, c double")
    chosen = spark.createDataFrame([(1, 1, "Derecho", 0.51, 1.0)], "form_id long, lugar int, carrera string, afinidad double, match double")
    got = {r.form_id: r.razonamiento for r in recommend.explain(profiles, chosen, spark.createDataFrame([(1, 0.5)], "form_id long, coherencia double")).collect()}
    assert got[2] == recommend.SENTENCES["none"]
    assert got[1] == " ".join([
        "Tu perfil del test destaca en Realista (práctico, manual, técnico) (0.90), seguido de Social (ayudar, enseñar, cuidar) (0.30).",
        "De lo que escribiste, la carrera con mejor encaje es 'Derecho' (afinidad con el test: 0.51, similitud con tu texto: 1.00).",
        recommend.SENTENCES["alert"], recommend.SENTENCES["apart"].replace("%.2f", "0.50"),
    ])


@pytest.mark.parametrize(
    ("nivel", "nivel_max", "carrera", "institucion", "ok"),
    [
        ("universitario", "sin_especificar", "pub", "indiferente", True), ("universitario", "universitario", "pub", "indiferente", True), ("universitario", "tecnico", "pub", "indiferente", False),
        ("universitario", "cetpro", "pub", "indiferente", False), ("tecnico", "universitario", "pub", "indiferente", True), ("tecnico", "tecnico", "pub", "indiferente", True), ("tecnico", "cetpro", "pub", "indiferente", False),
        ("cetpro", "universitario", "pub", "indiferente", True), ("cetpro", "tecnico", "pub", "indiferente", True), ("cetpro", "cetpro", "pub", "indiferente", True), ("cetpro", "sin_especificar", "pub", "publica", True),
        ("tecnico", "tecnico", "pub", "privada", False), ("tecnico", "tecnico", "both", "privada", True), ("tecnico", "tecnico", "both", "publica", True), ("tecnico", "cetpro", "both", "publica", False),
        ("universitario", "universitario", "unknown", "privada", True), ("universitario", "universitario", None, "privada", True), ("universitario", "tecnico", None, "privada", False), ("universitario", "universitario", "pub", "sin_especificar", True),
        ("universitario", "sin_especificar", "pub", "privada", False), ("universitario", "sin_especificar", None, "sin_especificar", True), ("tecnico", "universitario", "both", "indiferente", True),
        ("cetpro", "cetpro", "unknown", "publica", True), ("cetpro", "cetpro", "pub", "privada", False), ("tecnico", "sin_especificar", "both", "privada", True), ("universitario", "cetpro", "unknown", "publica", False),
    ],
)
def test_affordability(spark, nivel, nivel_max, carrera, institucion, ok):
    places = proposal.institution_sets(spark.createDataFrame([("pub", "publico"), ("both", "publico"), ("both", "privada")], "carrera string, institucion string"), {"publico": "publica"})
    df = spark.createDataFrame([(carrera, nivel, nivel_max, institucion)], "carrera string, nivel string, nivel_max string, institucion string")
    r = proposal.affordable(df, places).first()
    assert r.financiable == ok and (r.descarte is None) == ok


def test_compare_and_missing(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "k long, a string, b long")
    b = spark.createDataFrame([(1, "x", None), (2, "z", 1), (3, "w", 2)], "k long, a string, b long")
    assert {r.columna: (r.iguales, r.distintos, r.solo_a, r.solo_b) for r in monitor.compare_results(a, b, ["k"]).collect()} == {"a": (1, 1, 0, 1), "b": (2, 0, 0, 1)}


def test_medians_by_counting(spark):
    """Few and many rounds, ties, one value many times, ranges over many powers of ten, null groups and values."""
    import random
    import statistics

    rng = random.Random(8)
    rows = [("even", float(x)) for x in range(100)] + [("odd", rng.uniform(-5, 5)) for _ in range(301)] + [("one", 4.25), (None, 1.0), (None, 3.0), ("none", None), ("odd", None)]
    rows += [("wide", 10.0 ** rng.uniform(-9, 9) * rng.choice([-1, 1])) for _ in range(500)] + [("same", 7.5)] * 400 + [("same", 7.0), ("two", 1.0), ("two", 1e308), ("low", -1e308), ("low", 1e308)]
    log = spark.createDataFrame(rows, "stage string, seconds double").repartition(5)
    values = {}
    for k, v in rows:
        values.setdefault(k, []).extend([] if v is None else [v])
    stats = {r.stage: r for r in monitor.run_stats(log).collect()}
    assert set(stats) == set(values)
    for k, v in values.items():
        assert stats[k].n == len(v) and (stats[k].mediana is None if not v else stats[k].mediana == pytest.approx(statistics.median(v), rel=1e-12))
    for buckets, held in ((512, 20), (4096, 10_000)):
        wanted = [(k, r, min(v), max(v)) for k, v in values.items() if v for r in {1, (len(v) + 1) // 2, len(v)}]
        got = monitor.value_at_rank(log.where("seconds IS NOT NULL"), spark.createDataFrame(wanted, "stage string, rank long, lo double, hi double"), "stage", "seconds", buckets, held)
        assert {(r.stage, r.rank): r.seconds for r in got.collect()} == {(k, r): sorted(values[k])[r - 1] for k, r, *_ in wanted}
    assert "percentile" not in _plan(monitor.run_stats(log)).lower() and "median(" not in _plan(monitor.run_stats(log)).lower()


def test_nearest_entries_equal_all_pairs(spark):
    """Ties, zero vectors, few entries, and that few pairs are met."""
    import random

    rng = random.Random(2)
    letters = [f"{x} double" for x in recommend.LETTERS]
    point = lambda: tuple(rng.choice([0.0, 0.1, 0.5, 1.0]) if rng.random() < 0.4 else rng.random() for _ in range(6))
    for n, k in ((2, 3), (40, 3), (900, 5)):
        entries = [(i, f"c{i}", *(point() if i % 50 else (0.0,) * 6)) for i in range(n)]
        entries += [(n + i, f"copy{i}", *entries[i % n][2:]) for i in range(n // 10)]
        catalog = storage.settle(spark.createDataFrame(entries, f"ord int, carrera string, {', '.join(letters)}"), "catalog")
        forms = storage.settle(spark.createDataFrame([(i, *(point() if i else (0.0,) * 6)) for i in range(60)], f"form_id long, {', '.join(letters)}"), "forms")
        every = recommend.cosine_affinity(forms, catalog).withColumn("afinidad", F.round("afinidad", 9)).collect()
        want = {}
        for r in sorted(every, key=lambda r: (-r.afinidad, r.ord)):
            want.setdefault(r.form_id, []).append((r.ord, r.afinidad))
        got = {}
        for r in sorted(recommend.nearest_entries(forms, catalog, k).collect(), key=lambda r: r.lugar):
            got.setdefault(r.form_id, []).append((r.ord, r.afinidad))
        assert got == {i: v[:k] for i, v in want.items()}


def test_second_batch_computes_new_files_only(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def work(row):
        calls.add(1)
        if row["content"] == "bad":
            raise ValueError("bad")
        return {"n": len(row["content"]), "who": row["sexo"]}

    schema, store = "n int, who string", f"file://{tmp_path}/cache"
    files = lambda rows: spark.createDataFrame(rows, "id long, content string, sexo string").repartition(3)
    one = [(1, "aa", "F"), (2, "aa", "F"), (3, "aa", "M"), (4, "bad", "F"), (5, "cccc", "M")]
    got = {r.id: (r.cached, r.n, r.who, r.ok, r.error) for r in ingest.process_cached(files(one), work, schema, store, "b1").collect()}
    assert got == {1: (False, 2, "F", True, None), 2: (False, 2, "F", True, None), 3: (False, 2, "M", True, None), 4: (False, None, None, False, "bad"), 5: (False, 4, "M", True, None)}
    assert calls.value == 4
    two = [*one, (6, "eeeee", "F"), (7, "cccc", "M")]
    got = {r.id: (r.cached, r.n, r.ok) for r in ingest.process_cached(files(two), work, schema, store, "b2").collect()}
    assert got == {1: (True, 2, True), 2: (True, 2, True), 3: (True, 2, True), 4: (False, None, False), 5: (True, 4, True), 6: (False, 5, True), 7: (True, 4, True)}
    assert calls.value == 6  # the new file, and the failure again
    for _ in range(2):
        ingest.process_cached(files(two[4:]), work, schema, store, "b2").collect()
    assert calls.value == 6 and ingest.stored(spark, store).count() == 4


def _evaluation(spark, ids, mark="si"):
    forms = spark.createDataFrame([(i, f"n{i}", "F") for i in ids], "form_id long, nombre string, sexo string")
    marks_of = spark.createDataFrame([(i, f"E{k}", mark) for i in ids for k in range(3)], "form_id long, item string, opcion string")
    ranked = spark.createDataFrame([(i, "T1", 3, 40, 1) for i in ids], "form_id long, tipo string, pd int, baremo int, posicion int")
    suggested = spark.createDataFrame([(i, "x", "T1", True) for i in ids], "form_id long, carrera string, tipo string, es_principal boolean")
    return ingest.evaluation_tables(forms, marks_of, ranked, suggested)


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    dest = f"file://{tmp_path}/evaluation"
    ingest.write_evaluation(_evaluation(spark, range(1, 40)), dest, "a", 4)
    ingest.write_evaluation(_evaluation(spark, range(100, 120)), dest, "b", 4)
    ingest.write_evaluation(_evaluation(spark, range(1, 21), "no"), dest, "a", 4)  # fewer forms, other marks
    got = ingest.read_evaluation(spark, dest)
    assert {name: df.count() for name, df in got.items()} == {"formulario": 40, "marca": 120, "resultado": 40, "carrera_sugerida": 40}
    assert {(r.lote, r.puntaje) for r in got["marca"].select("lote", "puntaje").distinct().collect()} == {("a", 0), ("b", 1)}


def test_deletion_rewrites_touched_partitions_only(spark, tmp_path):
    dest = f"file://{tmp_path}/evaluation"
    ingest.write_evaluation(_evaluation(spark, range(1, 60)), dest, "a", 4)
    ingest.write_evaluation(_evaluation(spark, [500, 501]), dest, "b", 4)
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    before = files()
    ingest.delete_stored(spark, dest, spark.createDataFrame([(7,), (500,), (501,), (999,)], "form_id long"))
    after = files()
    left = ingest.read_evaluation(spark, dest)
    assert all(set(r.form_id for r in df.select("form_id").distinct().collect()) == set(range(1, 60)) - {7} for df in left.values())
    place = lambda p: str(p.parent)
    group = ingest.read_evaluation(spark, dest)["formulario"]
    kept = [p for p in before if p in after]
    assert len(kept) == sum(place(p).count("lote=a") for p in before) - len({place(p) for p in before if "lote=a" in place(p) and p not in after}) and len(kept) >= 3 * 4
    assert not any("lote=b" in place(p) for p in after) and group.count() == 58


def test_database_sink_replaces_a_batch(spark):
    url = "jdbc:derby:memory:evaluation;create=true"
    ingest.write_evaluation_jdbc(_evaluation(spark, range(30)), url, "a")
    ingest.write_evaluation_jdbc(_evaluation(spark, range(30, 35)), url, "b")
    ingest.write_evaluation_jdbc(_evaluation(spark, range(10)), url, "a")
    read = lambda name: spark.read.format("jdbc").options(url=url, dbtable=name).load()
    assert {n: read(n).count() for n in ("formulario", "marca", "resultado", "carrera_sugerida")} == {"formulario": 15, "marca": 45, "resultado": 15, "carrera_sugerida": 15}
    assert {r.form_id for r in read("formulario").collect()} == {*range(10), *range(30, 35)} and read("marca").where("lote = 'a'").count() == 30


# ---- plans


def test_catalogues_are_not_broadcast_by_force(spark):
    """Joins with the catalogue keep no nested loop and no broadcast hint; sizes decide."""
    from tallyforge.plans.queries import QUERIES

    for name in ("f5_best_two_pairs", "f6_suggest", "g5_search_fuzzy", "h4_career_similarity"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        assert "BroadcastNestedLoopJoin" not in plan.executedPlan().toString(), name
        assert "ResolvedHint (strategy=broadcast)" not in plan.analyzed().toString(), name


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_are_equi_joins_without_python(spark):
    from tallyforge.plans.queries import QUERIES

    for name in ("e2_norm_scores", "e5_rank_types", "f3_pair_affinity", "d13_classify_forms", "c17_pixels_to_cells"):
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name
    window = _plan(classify.classify_forms(_signals(spark, [])))
    assert window.count("hashpartitioning(form_id") == 1


def test_only_counted_tables_are_broadcast(spark):
    keys = spark.range(50)
    of = lambda rows: spark.range(200).join(storage.small(keys, rows), "id")._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in of(50) and "strategy=broadcast" not in of(49) and "strategy=merge" in of(49)
