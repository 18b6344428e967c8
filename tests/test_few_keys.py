"""Answers and scores are never dealt by the few items or norms that they meet, and a deletion sorts no table, however little the planner would broadcast."""

import pytest
from pyspark.sql import functions as F

from tallyforge.plans.fixtures import view
from tallyforge.sources import ingest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_answers_and_scores_are_dealt_by_form(spark, no_broadcast):
    lines = plan(view(spark, FOLDER, "normed")).splitlines()
    dealt = [line for line in lines if "Exchange hashpartitioning(" in line]
    assert dealt
    assert not [line for line in dealt if any(f"hashpartitioning({few}#" in line for few in ("item", "sexo"))]


@pytest.mark.parametrize("rows", [1_000_000, 3])  # broadcast, and each task its share
def test_a_deletion_sorts_no_table(spark, no_broadcast, rows):
    forms = spark.range(100).select(F.when(F.col("id") != 50, F.col("id")).alias("form_id"), F.lit("x").alias("nombre"))
    gone = spark.createDataFrame([(i,) for i in (0, 7, 7, 14, 98, 500, None)], "form_id long")
    left = ingest.delete_forms({"formulario": forms}, gone, rows)["formulario"]
    assert "Sort" not in plan(left)
    assert left.columns == ["form_id", "nombre"]
    kept = [r.form_id for r in left.collect()]
    assert sorted(i for i in kept if i is not None) == [i for i in range(100) if i not in (0, 7, 14, 50, 98)]
    assert kept.count(None) == 1
