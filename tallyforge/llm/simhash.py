"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Method: each text gets a 64-bit fingerprint. Bit positions are labelled with the
non-zero vectors of GF(2)^(r+1); each non-zero vector v selects the positions
whose label has an odd product with v, which gives 2^(r+1) - 1 masks of about
half the bits. Two fingerprints that differ in at most r bits agree on at least
one mask, always, so the tables lose no pair.

A bucket is never expanded into its pairs. Its members are first tied to the
bucket's least and greatest fingerprint; buckets whose members then share one
component are done. In the others, fingerprints of different components are
compared in blocks of bounded size, and only true links come out, one for each
pair of components that a block meets.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; copies share a fingerprint and are handled once; rows with the same
doc_id are rows of their own; an empty table gives an empty result; a group
whose ids are all null has a null component_id.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, table
from .components import components

BITS = 64
# Largest number of fingerprints of a bucket that a block holds; larger buckets are compared block against block.
BLOCK_ROWS = 4096


def fingerprint(data: bytes, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text as a signed 64-bit number: a bit is 1 if it is set in over half of the shingles' XXH64."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        shingles = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-width].tolist()]
        of = xxhash.xxh64_intdigest
        shingles = [of(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    hashes = np.fromiter(shingles, np.uint64, len(shingles))
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    out = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)
    return int(out[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 4, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """Adds `fp`, the signed 64-bit fingerprint of the whole text."""
    return map_texts(docs, lambda texts: {"fp": [fingerprint(x, width, seed) for x in texts]}, "fp bigint", text, keep)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks, as signed numbers. Position i has the label 1 + i mod (2^(radius+1) - 1)."""
    vectors = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(bits) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(t: np.ndarray, fp: np.ndarray, comp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components linked inside runs of equal t, each pair once. Runs are short or of at most two blocks."""
    found: list[np.ndarray] = []
    starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(t)])
    short = 48
    longest = int(min(short, sizes[sizes <= short].max(initial=1)))
    in_short = np.repeat(sizes <= short, sizes)
    for s in range(1, longest):
        hit = (t[s:] == t[:-s]) & in_short[s:] & (comp[s:] != comp[:-s])
        at = np.flatnonzero(hit)
        at = at[np.bitwise_count(fp[at] ^ fp[at + s]) <= radius]
        found.append(np.stack([comp[at], comp[at + s]], axis=1))
    for start, size in zip(starts[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
        f, c = fp[start : start + size], comp[start : start + size]
        for i in range(0, size, 256):
            near = (np.bitwise_count(f[i : i + 256, None] ^ f[None, i:]) <= radius) & (c[i : i + 256, None] != c[None, i:])
            x, y = np.nonzero(near)
            if len(x):
                found.append(np.unique(np.stack([c[i + x], c[i + y]], axis=1), axis=0))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.concatenate(found)
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _links_of_sorted(batches, radius: int):
    """Rows (run, fp, comp) sorted by run; a run that a batch breaks off is carried over."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)]

    def out(parts):
        a, b = _links(*parts, radius)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
        new[1] = new[1].view(np.uint64)
        rest = [np.concatenate(x) for x in zip(rest, new, strict=True)]
        if len(rest[0]) > 20_000 and rest[0][0] != rest[0][-1]:
            cut = int(np.flatnonzero(rest[0] != rest[0][-1])[-1]) + 1
            yield out([x[:cut] for x in rest])
            rest = [x[cut:] for x in rest]
    yield out(rest)


def fingerprint_components(fps: DataFrame, radius: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """fp, root for every distinct fingerprint linked to another; fps has the distinct fingerprints in `fp`."""
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(covering_masks(radius))])
    entries = fps.select("fp", F.explode(masks).alias("e")).select("e.t", "e.key", "fp")
    shared = materialize(entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "buckets")
    members = materialize(entries.join(shared.hint("merge"), ["t", "key"]), "members")
    ends = F.array("lo", "hi")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("end"))) <= radius
    tied = members.select("fp", F.explode(ends).alias("end")).where((F.col("fp") != F.col("end")) & near)
    first = components(tied, "fp", "end")
    known = members.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("t", "key", "n", "fp", F.coalesce("root", "fp").alias("comp"))
    mixed = known.groupBy("t", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("t", "key")
    # Large buckets are cut into blocks, and each pair of blocks is a run of its own.
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    runs = (
        known.join(mixed.hint("merge"), ["t", "key"])
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("run"), "fp", "comp")
    )
    runs = runs.repartition("run").sortWithinPartitions("run")
    links = materialize(runs.mapInArrow(partial(_links_of_sorted, radius=radius), "a bigint, b bigint"), "links")
    second = components(links, "a", "b")
    moved = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(F.col("node").alias("fp"), F.coalesce("top", "root").alias("root"))
    # Roots of the first pass, and fingerprints alone in it, that the second pass moves.
    return materialize(moved.unionByName(second.select(F.col("node").alias("fp"), "root")), "roots")


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, radius: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, fp of every row; and fp, first of every fingerprint, where first (no_id, doc_id, text_key) is its component's first document."""
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("text_key", F.xxhash64("text"))
    marked = materialize(with_fingerprint(keyed, "text", width, seed, ["doc_id", "text_key"]), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    least = materialize(marked.groupBy("fp").agg(F.min(first).alias("first")), "copies")
    roots = fingerprint_components(least.select("fp"), radius)
    # Both sides are written, so that the join reads them anew and Spark can split a root with very many fingerprints.
    rooted = materialize(least.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    groups = materialize(rooted.groupBy("root").agg(F.min("first").alias("least")), "groups")
    return marked, materialize(rooted.join(groups.hint("merge"), "root").select("fp", F.col("least").alias("first")), "of_fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id for every row of `docs`: documents whose fingerprints differ in at most `radius` bits are linked."""
    marked, of_fp = _grouped(docs, doc_id, text, width, radius, seed)
    return marked.join(of_fp, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def first_rows(docs: DataFrame, firsts: DataFrame, marked: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of `docs` that firsts.first (doc_id, text_key) names; one row of those equal in both.

    marked: doc_id, text_key of all rows. Texts move once, to meet the firsts; only
    rows that repeat id and text are grouped, the least as JSON stays.
    """
    repeats = materialize(marked.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toDF("__r_id", "__r_text", "n"), "repeats")
    named = firsts.select(F.col("first.doc_id").alias("__k_id"), F.col("first.text_key").alias("__k_text"))
    again = F.col("__k_id").eqNullSafe(F.col("__r_id")) & (F.col("__k_text") == F.col("__r_text"))
    keep = materialize(named.join(repeats, again, "left").select("__k_id", "__k_text", F.col("n").isNotNull().alias("__again")), "firsts")
    key = F.xxhash64(F.col(f"`{text}`"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__k_id")) & (key == F.col("__k_text"))
    once = docs.join(keep.where("not __again"), same, "left_semi")
    if keep.where("__again").isEmpty():
        return once
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = docs.join(keep.where("__again"), same, "left_semi").groupBy(F.col(f"`{doc_id}`"), key).agg(F.min_by(whole, F.to_json(whole)).alias("__row"))
    return once.unionByName(least.select("__row.*"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """The rows of `docs` that come first in their component, by doc_id, then a hash of the text; one row of those equal in both."""
    marked, of_fp = _grouped(docs, doc_id, text, width, radius, seed)
    return first_rows(docs, of_fp.select("first").distinct(), marked, doc_id, text)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all `documents`."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
