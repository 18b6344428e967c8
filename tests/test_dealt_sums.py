"""Sums meet the forms in as many tasks as the session's shuffles have, and are not put together by their size."""

from pyspark.sql import functions as F

from tallyforge.operators import scoring


def test_raw_scores_keep_their_tasks(spark):
    forms = spark.range(200).withColumnRenamed("id", "form_id")
    items = spark.createDataFrame([("T1", 1, "E", "E1"), ("T1", 1, "P", "P2"), ("T2", 2, "H", "H1")], "tipo string, tipo_ord int, bloque string, item string")
    marks = forms.where("form_id % 2 = 0").crossJoin(items.select("item")).withColumn("opcion", F.lit("si"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = scoring.raw_scores(marks, items, forms).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len({r.task for r in got}) == 7
    assert {(r.form_id, r.tipo): (r.pd_e, r.pd_p, r.pd_h, r.pd) for r in got} == {(f, t): x if f % 2 == 0 else (0, 0, 0, 0) for f in range(200) for t, x in (("T1", (1, 1, 0, 2)), ("T2", (0, 0, 1, 1)))}
