"""An image's tokens are summed up in its row: nothing is shuffled, and the lists are those of the table with a row for each token."""

from pyspark.sql import functions as F

from tallyforge.operators import marks
from tallyforge.plans.fixtures import view
from tallyforge.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_summary_moves_no_token(spark):
    plan = QUERIES["b12_token_summary"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_packed_tokens_are_the_tokens(spark, tmp_path):
    texts = ["", " ", "a", " b  c ", "d\ne\tf g", "ñ 漢字 😀", None, "w " * 3000]
    spark.createDataFrame([(7 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    packed, tokens = (view(spark, str(tmp_path), name) for name in ("packed_tokens", "tokens"))
    unpacked = packed.select("image_id", F.posexplode(F.arrays_zip("text", "conf")).alias("pos", "t")).select("image_id", F.col("pos") + 1, "t.text", "t.conf")
    assert rows(unpacked) == rows(tokens.select("image_id", "pos", "text", "conf"))
    assert rows(marks.token_summary(marks.token_lists(tokens))) == rows(marks.token_summary(packed))


def test_summary_of_tokens(spark):
    tokens = spark.createDataFrame(
        [(1, 2, " b ", "7.5"), (1, 1, "a", "x"), (1, 3, "  ", "91"), (1, 10, "33c3", "-1"), (2, 1, None, "-1"), (2, 2, "", None), (3, 1, "z", "0")],
        "image_id long, pos int, text string, conf string",
    )
    assert rows(marks.token_summary(marks.token_lists(tokens))) == [(1, "ab33c3", 91.0), (2, "", 0.0), (3, "z", 0.0)]
