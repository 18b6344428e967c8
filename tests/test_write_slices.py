"""A stored partition is written by several tasks, and its forms stay in it."""

from pyspark.sql import functions as F

from tallyforge.sources import ingest


def test_partitions_are_written_in_slices(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        marks = spark.range(2000).select(F.col("id").alias("form_id"), F.lit("E1").alias("item"))
        ingest.write_evaluation({"marca": marks}, str(tmp_path), groups=2)
        assert all(len(list(p.glob("*.parquet"))) > 3 for p in tmp_path.glob("marca/lote=0/grupo=*"))
        ingest.delete_stored(spark, str(tmp_path), spark.range(0, 2000, 7).select(F.col("id").alias("form_id")))
        left = spark.read.parquet(f"{tmp_path}/marca")
        assert sorted(r.form_id for r in left.select("form_id").collect()) == [i for i in range(2000) if i % 7]
        assert all(len(list(p.glob("*.parquet"))) > 1 for p in tmp_path.glob("marca/lote=0/grupo=*"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
