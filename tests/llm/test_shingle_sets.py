"""The near-dedup stage against the exact similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from tallyforge.llm import shingle_sets, simhash


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def expected_firsts(texts):
    """The smallest id of each component of pairs at similarity 0.8 or more, and these pairs."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = []
    for i in range(len(sets)):
        for j in range(i):
            both, total = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * total:
                pairs.append((j, i))
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {find(i) for i in range(len(sets))}, pairs


def near_copies(seed=8):
    """Texts with copies that have 1 to 12 of their words replaced, on both sides of 0.8, chains of copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))

    def edited(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = word()
        return words

    out = ["", " \n", "a b", "A  B", "a b c", "one two three four five"]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        out.append(" ".join(base))
        out += [" ".join(edited(base, rng.randint(1, 12))) for _ in range(4)]
    chain = [word() for _ in range(200)]
    for _ in range(60):
        chain = edited(chain, 3)
        out.append(" ".join(chain))
    center = [word() for _ in range(150)]
    out += [" ".join(edited(center, 6)) for _ in range(40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("block_rows", "block_shingles"), [(4, shingle_sets.BLOCK_SHINGLES), (256, 300), (256, shingle_sets.BLOCK_SHINGLES)])
def test_stage_keeps_one_of_each_component(spark, block_rows, block_shingles):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, pairs = expected_firsts(texts)
    if block_rows == shingle_sets.BLOCK_ROWS and block_shingles == shingle_sets.BLOCK_SHINGLES:
        kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    else:
        kept = shingle_sets.one_of_each(docs, block_rows=block_rows, block_shingles=block_shingles)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    far = [(a, b) for a, b in pairs if ((simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())) & (1 << 64) - 1).bit_count() > 4]
    assert len(far) > 50  # the rule of op3 misses these


def test_bands_find_pairs_at_the_limit():
    """Recall of the buckets over pairs of sets at similarity 0.8, and how often they bring together pairs at 0.1."""
    import numpy as np

    rng = np.random.default_rng(4)
    for both, own, least, most in ((160, 20, 0.997, 1), (10, 45, 0, 0.01)):
        met = 0
        for _ in range(1000):
            x = rng.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, both + 2 * own, dtype=np.uint64)
            met += bool(np.any(shingle_sets.band_keys(x[: both + own]) == shingle_sets.band_keys(np.r_[x[:both], x[both + own :]])))
        assert least <= met / 1000 <= most


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (None, "a b"), (4, "a b"), (None, "x y z"), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) if r.doc_id is not None else (0, r.text) for r in shingle_sets.one_of_each(docs).collect())
    assert got == [(0, "x y z"), (1, None), (4, "a b")]
    mapped = docs.selectExpr("*", "map('k', doc_id) AS m")  # columns that can't be ordered
    assert shingle_sets.one_of_each(mapped).count() == 3
    assert shingle_sets.one_of_each(docs.where("false")).count() == 0


def test_covering_tables_give_a_key(spark):
    """Sets whose fingerprints differ in at most 4 bits, also by way of others, share one more key; farther ones and empty sets don't."""
    rows = [(1, [11], 0b1111), (2, [12], 0b11111111), (3, [13], 0), (4, [14], -1), (5, [], 0)]
    got = {r.fp: r.bands for r in shingle_sets._with_simhash(spark.createDataFrame(rows, "fp long, bands array<bigint>, sim long").selectExpr("*", "fp AS first")).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [11, 12, 13, 14] and got[5] == []
    assert got[1][1] == got[2][1] == got[3][1] != got[4][1]
