"""Ink of a cell is the same for letters that are translated at once and for those that are not, and texts are cut by letters."""

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import layout
from tallyforge.plans.fixtures import VIEWS, view
from tallyforge.plans.queries import QUERIES

LETTERS = "".join(map(chr, [*range(1, 0x300), 0x2028, 0x4E2D, 0xFFFD, 0x1F600, 0x1F601, 0x10FFFF]))


def test_any_letter(spark, tmp_path):
    texts = ["", None, "\x00ab\r\n'\"\\", LETTERS, LETTERS[:384], "é" * 385, "\U0001f600" * 400]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for doc, text in enumerate(texts, 1):
        for k in range(0, len(text or ""), 384):
            rows = [text[k : k + 384][i : i + 24] for i in range(0, len(text[k : k + 384]), 24)]
            ink = ["".join("10"[ord(c) % 5 > 0] for c in r) for r in rows]
            want[doc * 100000 + k // 384] = (len(rows), len(rows[0]), ink, [[ord(c) % 256 for c in r] for r in rows])
    assert {r.cell_id: (r.h, r.w, r.ink, r.gray) for r in view(spark, str(tmp_path), "packed_cells").collect()} == want


def test_text_is_cut_in_one_pass():
    assert "substring(text" not in VIEWS["packed_cells"]


@pytest.mark.parametrize("runs", [True, False])
def test_ink_and_runs_give_the_same_cuts(spark, runs):
    """Gaps of 40 rows between others of 10: one solid in three rows together, one in none, one whose best row is too low, one at the end of its middle third."""
    cuts = spark.createDataFrame([(p, y) for p in range(1, 5) for y in (0, 10, 20, 30, 70, 80)], "page_id long, pos int")
    row = lambda a, b: "0" * a + "1" * (b - a) + "0" * (20 - b)
    rows = [(1, 50, row(0, 4)), (1, 49, row(4, 6)), (1, 51, row(6, 8)), (1, 53, row(0, 20)[:4]), (2, 50, row(0, 5)), (2, 48, row(5, 20)[:7]), (3, 50, row(0, 3)), (3, 31, row(0, 20)), (4, 55, row(0, 7)), (4, 56, row(0, 20)), (4, 5, row(0, 20))]
    ink = spark.createDataFrame(rows, "page_id long, y int, ink string").withColumn("w", F.lit(20))
    lines = ink.withColumn("runs", layout.runs("ink")).drop("ink") if runs else ink
    got = layout.insert_missing_cuts(cuts, lines, ["page_id"])
    assert sorted((r.page_id, r.pos) for r in got.join(cuts, ["page_id", "pos"], "left_anti").collect()) == [(1, 50), (4, 55)]


def test_rows_are_shuffled_once(spark):
    plan = QUERIES["c11_insert_missing_cuts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
