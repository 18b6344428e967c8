"""Near-duplicates by the Jaccard similarity of word shingles, found by SimHash with covering tables, then by MinHash bands, and checked exactly.

Method: a text is the set of its shingles of five words, each a 64-bit hash. Texts
of equal sets are handled once. Texts whose SimHash fingerprints the covering tables
of `simhash` link, at 4 or fewer of 64 bits, share a bucket. That radius holds a part of the pairs
at similarity 0.8 alone, so sets that agree in all five minima of one of 25
bands share a bucket as well; a pair at similarity 0.8 shares none of these with probability
(1 - 0.8^5)^25 = 0.00005, a nearer pair more rarely. Whether two sets of a bucket
are linked is decided by their exact similarity, on the whole sets.

A bucket is never expanded into its pairs. Its members are first compared with the
bucket's least and greatest set; buckets whose members then share one component are
done. In the others, sets of different components are compared in blocks of bounded
size. Buckets with the same members are handled once.

Covering tables for all such pairs do not pay here: at similarity 0.8 two fingerprints
differ in up to 13 of 64 bits, and parts short enough to cover that many hold a fixed
share of all documents in each bucket.

Defined cases: texts of fewer words than a shingle are one shingle; null, empty and
blank texts are copies of each other and similar to nothing else.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, small_batches
from .components import components
from .simhash import fingerprint, fingerprint_components, first_rows
from .words import WordHashes, gram_hashes, mix, word_hashes

WIDTH, BANDS, BAND_ROWS = 5, 25, 5
# The least similarity of a link, as a fraction.
ALIKE = (4, 5)
# Number of sets of a bucket that a block holds; larger buckets are compared block against block.
BLOCK_ROWS = 256
# And of their shingles, so that a block of long texts has fewer sets: 32 MB.
BLOCK_SHINGLES = 1 << 22
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(43).integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_memo = WordHashes()


def shingle_set(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of all shingles of a text."""
    words = word_hashes(data.lower().split(), _memo)
    return np.unique(gram_hashes(words, min(width, len(words)))) if len(words) else np.empty(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the band's minima."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 11):
        least = np.minimum(least, (_FACTORS[:, None] * shingles[None, at : at + (1 << 11)]).min(axis=1))
    return mix((mix(least).reshape(BANDS, BAND_ROWS) * _PLACES).sum(axis=1, dtype=np.uint64))


def alike(both: int, a: int, b: int) -> bool:
    """Whether sets of a and b shingles with `both` in common are linked."""
    return ALIKE[1] * both >= ALIKE[0] * (a + b - both) and both > 0


def _set_columns(texts: list[bytes], width: int) -> dict:
    import xxhash

    fps, bands = [], []
    for data in texts:
        s = shingle_set(data, width)
        of = xxhash.xxh64_intdigest(s.tobytes(), 5) if len(s) else 0
        fps.append(of - (1 << 64) if of >> 63 else of)
        bands.append(band_keys(s).view(np.int64) if len(s) else [])
    return {"fp": fps, "bands": bands, "sim": [fingerprint(data, width) for data in texts]}


def _links_of_run(fp: list[int], comp: list[int], own: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of components linked in a run: rows of different blocks, or of the only one."""
    up = {c: c for c in comp}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    order = sorted(range(len(fp)), key=lambda i: (len(sets[i]), fp[i]))
    one = len(set(own)) == 1
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if not alike(len(sets[i]), len(sets[i]), len(sets[j])):
                break  # a longer set is no nearer
            if (one or own[i] != own[j]) and (a := find(comp[i])) != (b := find(comp[j])):
                if alike(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
                    up[max(a, b)] = min(a, b)
                    out.append((comp[i], comp[j]))
    return out


def _links_of_sorted(batches):
    """Rows (run, fp, comp, own, shingles) sorted by run; only one run is held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    now, held = None, ([], [], [], [])

    def out():
        found = _links_of_run(*held)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    for batch in batches:
        runs, *rest = (batch.column(i).to_pylist() for i in range(4))
        sets = batch.column(4)
        for k, run in enumerate(runs):
            if run != now and held[0]:
                yield out()
                held = ([], [], [], [])
            now = run
            for to, x in zip(held, (*(r[k] for r in rest), sets[k].values.to_numpy()), strict=True):
                to.append(x)
    if held[0]:
        yield out()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of `pairs` whose sets are alike."""
    left, right = (sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    tested = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", both.alias("both"), F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"))
    return tested.where((F.col("both") > 0) & (ALIKE[1] * F.col("both") >= ALIKE[0] * (F.col("n_a") + F.col("n_b") - F.col("both")))).select("a", "b")


def _set_of(texts: list[bytes], width: int) -> dict:
    sets = [shingle_set(t, width).view(np.int64) for t in texts]
    return {"shingles": sets, "n_shingles": [len(x) for x in sets]}


def _with_simhash(least: DataFrame) -> DataFrame:
    """`bands` with one more key, the component of the fingerprint `sim` under the covering tables; empty sets have none."""
    linked = fingerprint_components(least.select(F.col("sim").alias("fp")).distinct()).withColumnsRenamed({"fp": "sim", "root": "sim_root"})
    key = F.xxhash64(F.lit("simhash"), F.coalesce("sim_root", "sim"))
    bands = F.when(F.size("bands") > 0, F.concat("bands", F.array(key))).otherwise(F.col("bands"))
    return least.join(linked.hint("merge"), "sim", "left").select("fp", "first", bands.alias("bands"))


def _roots(least: DataFrame, texts: DataFrame, width: int, block_rows: int, block_shingles: int) -> DataFrame:
    """fp, root for every set linked to another. least: fp, first, bands of the distinct sets; texts: doc_id, text, text_key."""
    entries = least.select(F.explode("bands").alias("key"), "fp")
    members_of = [F.bit_xor(F.xxhash64("fp", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), *members_of).where("n > 1")
    shared = materialize(shared.groupBy("n", "lo", "hi", "x0", "x1").agg(F.min("key").alias("key")).drop("x0", "x1"), "buckets")
    members = materialize(entries.join(shared.hint("merge"), "key"), "members")
    wanted = least.join(members.select("fp").distinct().hint("merge"), "fp", "left_semi").select("fp", F.col("first.doc_id").alias("__w_id"), F.col("first.text_key").alias("__w_key"))
    same = F.col("doc_id").eqNullSafe(F.col("__w_id")) & (F.col("text_key") == F.col("__w_key"))
    found = texts.join(materialize(wanted, "wanted").hint("merge"), same).select("fp", "text").dropDuplicates(["fp"])
    sets = materialize(map_texts(found, partial(_set_of, width=width), "shingles array<bigint>, n_shingles int", "text", ["fp"]), "sets")

    ends = members.select("fp", F.explode(F.array("lo", "hi")).alias("end")).where("fp != end")
    pairs = materialize(ends.select(F.least("fp", "end").alias("b"), F.greatest("fp", "end").alias("a")).distinct(), "pairs")
    first = components(materialize(_linked(pairs, sets), "ties"), "a", "b")
    lengths = sets.select("fp", "n_shingles").hint("merge")
    known = members.join(first.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").join(lengths, "fp")
    known = materialize(known.select("key", "n", "fp", F.coalesce("root", "fp").alias("comp"), "n_shingles"), "known")
    # Members that all were compared with both ends need no more in buckets of three or fewer.
    mixed = known.where("n > 3").groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.sum("n_shingles").alias("total")).where("c0 != c1").select("key", "total")
    # Large buckets are cut into blocks, and each pair of blocks is a run of its own.
    runs = (
        known.join(mixed.hint("merge"), "key")
        .withColumn("blocks", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("total") / block_shingles)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("run"), "fp", "comp", "own")
    )
    runs = materialize(runs, "runs").join(sets.hint("merge"), "fp").select("run", "fp", "comp", "own", "shingles").repartition("run").sortWithinPartitions("run")
    second = components(materialize(runs.mapInArrow(_links_of_sorted, "a bigint, b bigint"), "links"), "a", "b")
    moved = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(F.col("node").alias("fp"), F.coalesce("top", "root").alias("root"))
    return materialize(moved.unionByName(second.select(F.col("node").alias("fp"), "root")), "roots")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of `docs` that come first in their component of similar texts, by doc_id, then a hash of the text; one row of those equal in both."""
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("text_key", F.xxhash64("text"))
    marked = materialize(map_texts(keyed, partial(_set_columns, width=width), "fp bigint, bands array<bigint>, sim bigint", "text", ["doc_id", "text_key"]), "marked")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    least = materialize(marked.groupBy("fp").agg(F.min(first).alias("first"), F.any_value("bands").alias("bands"), F.min("sim").alias("sim")), "copies")
    least = materialize(_with_simhash(least), "keyed")
    roots = _roots(least, keyed, width, block_rows, block_shingles)
    rooted = materialize(least.drop("bands").join(roots.hint("merge"), "fp", "left").select("first", F.coalesce("root", "fp").alias("root")), "rooted")
    return first_rows(docs, rooted.groupBy("root").agg(F.min("first").alias("first")), marked, doc_id, text)
