"""Repeated passages of one to three lines between unlike neighbours."""

import random

import pyarrow as pa

from tallyforge.llm import line_dedup


def test_short_passages_go_whole(spark):
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    rows, passages = [], []
    for k in range(90):
        passage = [[line(60)], [line(30), line(30)], [line(20), "", line(20), line(20)]][k % 3]
        passages.append(passage)
        for copy in range(2):
            before, after = ([line(rng.randint(3, 20)) for _ in range(rng.randint(0, 4))] for _ in range(2))
            rows.append((copy * 1000 + k, "\n".join([*before, *passage, *after]), "\n".join([*before, *after])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert got == {i: text if i < 1000 else rest for i, text, rest in rows}


def test_long_passages_go_over_many_pieces(spark):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    passage = [line(8) for _ in range(75)]
    own = [[line(5) for _ in range(3)] for _ in range(6)]
    parts = [(0, 75), (0, 75), (10, 60), (33, 75), (0, 75), (0, 75)]
    rows = [(i, "\n".join([*own[i], *passage[a:b]]), "\n".join([*own[i], *(passage[a:b] if i == 0 else [])])) for i, (a, b) in enumerate(parts)]
    rows += [rows[5], (None, "\n".join(passage), None)]  # a repeated row; a null id comes first
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string").repartition(3)
    got = line_dedup.without_repeats(docs).collect()
    whole = {r.doc_id: r.text for r in got}
    assert whole == {**{i: "\n".join(own[i]) for i in range(6)}, None: "\n".join(passage)}
    assert len(got) == 8 and sum(r.doc_id == 5 and r.text == whole[5] for r in got) == 2


def test_lines_stay_where_their_bytes_differ():
    texts = ["a\nb c\nd", "a\nb c\nd", None, ""]
    cut = lambda kept: [{"kept": kept, "lead": 0, "ranges": [{"first": 1, "last": 3, "n": 2}]}]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": texts, "__cut": [cut("b c\nd"), cut("b  c\nd"), None, None]})
    out = next(line_dedup._cut_lines([batch])).to_pydict()
    assert out["text"] == ["a", texts[1], None, ""]
    assert out["n_cut_chunks"] == [2, 0, 0, 0] and out["n_cut_lines"] == [2, 0, 0, 0] and out["n_lines"] == [3, 3, 0, 1]


def test_touching_chunks_are_compared_once(spark):
    schema = "doc_id long, text_key long, first int, last int, keep_id long, keep_key long, keep_first int"
    hit = spark.createDataFrame([(2, 7, 1, 5, 1, 9, 11), (2, 7, 3, 9, 1, 9, 13), (2, 7, 9, 12, 1, 9, 19), (2, 7, 20, 22, 1, 9, 11), (2, 7, 30, 31, None, 9, 0)], schema)
    got = sorted((r.keep_id or 0, r.a, r.b, r.begins, r.ends, sorted((x["first"], x["last"], x["n"]) for x in r.ranges)) for r in line_dedup.pieces(hit).collect())
    assert got == [(0, 0, 1, True, True, [(30, 31, 1)]), (1, 11, 13, True, True, [(20, 22, 1)]), (1, 11, 16, True, False, [(1, 6, 3)]), (1, 16, 22, False, True, [(6, 12, 0)])]


def line(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))


def test_passages_of_short_lines_go_whole(spark):
    """40 words and a window, in lines of 1 to 8 words, between unlike neighbours and across blank lines."""
    rng = random.Random(12)
    rows = []
    for k in range(60):
        words = [1, 2, 3, 5, 8, 1][k % 6]
        passage = [line(rng, words) for _ in range(-(-56 // words) + k % 4)]
        if k % 6 == 5:
            passage[7:7] = [""]
        for copy in range(2):
            before, after = ([line(rng, rng.randint(1, 9)) for _ in range(rng.randint(0, 30))] for _ in range(2))
            rows.append((copy * 1000 + k, "\n".join([*before, *passage, *after]), "\n".join([*before, *after])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert got == {i: text if i < 1000 else rest for i, text, rest in rows}


def test_rows_are_fewer_bytes_than_the_texts(spark, tmp_path):
    from pyspark.sql import functions as F

    for words in (1, 2, 5, 12, 40):
        rng = random.Random(words)
        texts = ["\n".join(line(rng, words) for _ in range(8000 // words)) for _ in range(24)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).withColumn("text_key", F.xxhash64("text"))
        folder = tmp_path / str(words)
        line_dedup.with_chunks(docs, ["doc_id", "text_key"], "text").select("doc_id", "text_key", F.inline("found")).write.parquet(str(folder))
        assert sum(f.stat().st_size for f in folder.glob("*.parquet")) < 0.8 * sum(map(len, texts)), words


def test_comparison_goes_on_around_a_chunk():
    texts = ["q\na\nb c\nd\ne\nz", "a\nb c\nd", "a\nb c\nx\ne"]
    cut = [{"kept": "p\na\nb c\nd\ne\nf", "lead": 2, "ranges": [{"first": 2, "last": 4, "n": 1}]}]
    whole = [{**cut[0], "ranges": [{"first": 1, "last": 3, "n": 1}]}]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": texts, "__cut": [cut, whole, whole]})
    out = next(line_dedup._cut_lines([batch])).to_pydict()
    assert out["text"] == ["q\nz", "", texts[2]] and out["n_cut_lines"] == [4, 3, 0] and out["n_cut_chunks"] == [1, 1, 0]
