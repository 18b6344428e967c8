"""Pairs of a form's entries stay in the form's task, and forms with the same entries ask for their pairs once."""

from pyspark.sql import functions as F

from tallyforge.operators import proposal
from tallyforge.sources.storage import settle


def test_pairs_come_from_lists(spark):
    listed = spark.createDataFrame([(f, x) for f in range(50) for x in ("a", "b", "b")] + [(50, "c"), (51, "a"), (51, "c")], "form_id long, carrera string")
    want = {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")}
    for other in (listed, listed.select("*")):
        pairs = proposal.asked_pairs(listed, other)
        assert {(r.a, r.b) for r in pairs.collect()} == want and pairs.count() == 4
    assert "Join" not in proposal.asked_pairs(listed, listed)._jdf.queryExecution().executedPlan().toString()


def test_means_of_each_list(spark):
    rows = [(1, "a", 1, True, False), (1, "b", 2, True, True), (1, "c", 3, False, True), (2, "a", 1, True, False)]
    candidates = settle(spark.createDataFrame(rows, "form_id long, carrera string, ord int, en_test boolean, en_alumno boolean"), "candidates")
    tops = settle(spark.createDataFrame([(1, "T1", "T2"), (2, "T1", "T2")], "form_id long, tipo1 string, tipo2 string"), "tops")
    similar = {("a", "b"): 2.0, ("a", "c"): 5.0, ("b", "c"): 7.0}
    similarity = settle(spark.createDataFrame([(x, y, s) for p, s in similar.items() for x, y in (p, p[::-1])], "a string, b string, similitud double"), "similarity")
    types = settle(spark.createDataFrame([("a", ["T1"]), ("b", ["T1", "T2"])], "carrera string, tipos array<string>"), "types")
    related = spark.createDataFrame([("T1", "T2")], "tipo string, rel string")
    scored = proposal.career_score(candidates, tops, similarity, types, related)
    got = {(r.form_id, r.carrera): (r.s_voc, r.s_prop, r.s_test, r.score) for r in scored.collect()}
    assert got == {(1, "a"): (8, 3.5, 2.0, 23.4), (1, "b"): (22, 7.0, 2.0, 66.1), (1, "c"): (0, 7.0, 6.0, 42.3), (2, "a"): (8, 0.0, 0.0, 13.0)}
    by = [line for line in scored._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert by and all("carrera" not in line for line in by)
