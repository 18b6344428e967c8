"""The registered corpus queries over files, and the pipeline stage by stage against brute force."""

from collections import Counter

import pytest
from test_corpus_operators import expected_hits, expected_targets
from test_row_operators import by_id, expected_quality
from test_shingle_sets import expected_firsts

import corpus_pipeline
from tallyforge.llm.queries import queries


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    long = [r[1] for r in rows if r[1] and len(r[1].split()) > 60 and r[0] is not None and r[0] % 10 == 8]
    items = [(i, " ".join(t.split()[5:30])) for i, t in enumerate(long[:4])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = docs.selectExpr("doc_id AS page_id", "concat('http://a/', doc_id) AS url", "text AS html", "lang AS digest", "source AS file")
    pages.write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, docs, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{path}/{t}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run_over_files(spark, folder, rows, name):
    n = queries()[name](spark, folder).count()
    assert n > 10 if name in ("op1_token_counts", "op13_source_divergence") else n == len(rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_on_empty_tables(spark, empty_folder, name):
    assert queries()[name](spark, empty_folder).count() == 0


def test_stages_against_brute_force(spark, folder, rows, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def run(k, df):
        name, stage = corpus_pipeline.STAGES[k]
        stage(spark, df, folder).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    one = run(0, docs)
    kept = [r for r in rows if expected_quality(r[1])[-1]]
    assert one.columns == columns and by_id(map(tuple, one.collect())) == by_id(kept)

    two = run(1, one)
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    least = {ordered[i][0] for i in expected_firsts([r[1] for r in ordered])[0]} - {None}
    got = by_id(map(tuple, two.collect()))
    assert two.columns == columns and [r[0] for r in got if r[0] is not None] == [r[0] for r in by_id(r for r in {x[:2]: x for x in kept if x[0] in least}.values())]

    three = run(2, two)
    clean = [r for r in got if not expected_hits(r[1], items)[-1]]
    assert three.columns == columns and by_id(map(tuple, three.collect())) == clean and 0 < len(got) - len(clean) <= 8

    four = run(3, three)
    copies = Counter(r[0] for r in map(tuple, four.collect()))
    assert four.columns == columns and set(copies.values()) <= {1, 2} and set(copies) <= {r[0] for r in clean}
    size = {r[0]: expected_quality(r[1])[0] for r in clean}
    by_source = Counter()
    for r in clean:
        by_source[r[3]] += size[r[0]]
    want = expected_targets(by_source)
    smallest = min(size.values())
    for s in by_source:
        taken = sum(copies[r[0]] * size[r[0]] for r in clean if r[3] == s)
        assert abs(taken - want[s]) <= smallest + 0.03 * want[s]

    last = run(4, four).collect()
    assert Counter(r.doc_id for r in last) == copies
    counts = Counter(r.shard for r in last)
    assert max(counts.values()) - min(counts.values()) <= 1 and {r.law for r in last} == {"rows"}
    for s in counts:
        assert sorted(r.slot for r in last if r.shard == s) == list(range(counts[s]))

    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, last))


def test_map_columns_travel_along(spark, docs, folder):
    """A documents table with a map, and with maps inside other columns, through all stages."""
    with_maps = docs.selectExpr("*", "map('a', doc_id) AS tags", "array(named_struct('m', map(1, lang))) AS nested")
    plain, mapped = docs, with_maps
    for name, stage in corpus_pipeline.STAGES:
        plain, mapped = (stage(spark, x, folder) for x in (plain, mapped))
        if name != "sharding":
            assert mapped.columns == with_maps.columns, name
    assert mapped.count() > 10
    assert abs(mapped.count() - plain.count()) <= 3  # copies are dealt by hashes of whole rows
