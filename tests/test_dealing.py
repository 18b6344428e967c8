"""Work on forms, answers and cuts is dealt over the session's tasks, however small the files are that they come from."""

import pytest
from pyspark.sql import functions as F

from tallyforge.plans.fixtures import view

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["marks", "marks_state", "marks_raw", "cuts"])
def test_views_have_as_many_tasks_as_shuffles(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert view(spark, FOLDER, name).select(F.spark_partition_id()).distinct().count() >= 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
