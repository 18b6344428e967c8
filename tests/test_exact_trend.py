"""Flags of a block whose columns weigh the same: 0.1 + 0.2 against 0.3, which doubles don't take for equal."""

from tallyforge.operators import classify

SIDES = [(0.1, 0.3), (0.2, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def signals(spark):
    rows = [(1, "E", i + 1, no, si, no, si, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5) for i, (no, si) in enumerate(SIDES)]
    return spark.createDataFrame(rows, "form_id long, bloque string, num int, " + ", ".join(f"{c}_{s} double" for c in ("dens", "centro", "stroke", "dt", "sym") for s in ("no", "si")))


def test_equal_columns_lean_to_si(spark):
    assert [r.num for r in classify.flag(signals(spark), "incoherent").where("incoherent").collect()] == [2]


def test_equal_columns_in_reviews_and_outcomes(spark):
    seen = classify.merge_review(classify.with_flags(classify.classify_vote(signals(spark).selectExpr("*", "0.02D AS umbral"))))
    assert not [r.num for r in seen.where("revisar AND num = 1").collect()]
    listed = classify.review_list(seen.selectExpr("*", "concat(bloque, num) AS item")).collect()
    assert [r.items_revisar[0] for r in listed] == ["E2"]
    items = classify.classify_forms(signals(spark))
    assert not [r.item for r in items.where("revisar").collect() if r.item == "E1"]
    assert classify.form_outcome(items).first().a_revisar == items.where("revisar AND num > 1").count()
