"""Constraints are checked on counts by form: what meets the forms is a row for each form, not each answer."""

from tallyforge.sources import ingest


def test_forms_meet_counts(spark):
    forms = spark.createDataFrame([(1, "a", "M"), (2, "b", "X")], "form_id long, nombre string, sexo string")
    marks = spark.createDataFrame([(1, "E1"), (1, "E1"), (3, "E1"), (3, "E2"), (None, "E1"), (2, None)], "form_id long, item string")
    scores = spark.createDataFrame([(1, "T1"), (4, "T1"), (4, "T1")], "form_id long, tipo string")
    found = ingest.check_evaluation(forms, marks, scores)
    assert {r.problema: r.n for r in found.collect()} == {"sexo": 1, "nombre largo": 0, "item nulo": 1, "marca repetida": 1, "resultado repetido": 1, "marca sin formulario": 3, "resultado sin formulario": 2}
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert all("Aggregate" in lines[i + 1] for i, line in enumerate(lines) if "Join LeftAnti" in line)
