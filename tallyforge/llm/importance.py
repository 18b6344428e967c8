"""Importance resampling towards a target distribution, on hashed n-grams.

Method: separators collapse to single spaces; a regular expression, searched with
overlapping matches and bounded by lookarounds, gives at each word the spans of the
n-grams that start there; the CRC of each span is counted in its bucket. The buckets of the
corpus and of the target text give a log ratio each; a document's weight is the sum
over its n-grams, and Gumbel noise from a hash of doc_id turns the highest scores
into a draw without replacement.

Each text is scanned once: its counts by bucket, at most `buckets` of them, are
written, and both the corpus totals and the weights are taken from there. The
totals are added up in each task before the shuffle; the driver gets one number for
each bucket. Ranks come from the histogram of scores, summed in two levels, so no
task sorts the corpus.

Defined cases: null, empty and blank texts have no n-grams, weight 0 and still a score;
an empty corpus gives an empty result, an empty target (or none) counts 0 in each bucket;
repeated rows count each and take ranks of their own; a null doc_id is hashed as ''
and comes first among ties; texts of any length are scanned in pieces; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, table
from .words import PLAIN

LONGEST, BUCKETS = 3, 10_000
LEAST_WORDS, PERCENT = 20, 5
# Matches held at a time, and distinct scores that one task sums.
PIECE, BLOCK = 8192, 4096


@lru_cache(maxsize=4)
def grams(longest: int):
    """At each word between spaces: group 1 is the word, and each further group the word after the last, looked at without being consumed."""
    import regex

    behind = reduce(lambda inner, _: rb"(?:( [^ ]++)" + inner + rb")?+", range(longest - 1), b"")
    return regex.compile(rb" ([^ ]++)(?=" + behind + rb")")


def checksums(data: bytes, longest: int = LONGEST) -> Iterator[list[int]]:
    """The CRC-32 of every run of 1 to `longest` words of the text, in pieces. A longer span's checksum continues that of the span before it."""
    line = b" " + b" ".join(data.translate(PLAIN).split()) + b" "
    places = map(methodcaller("groups"), grams(longest).finditer(line, overlapped=True))
    while found := list(islice(places, PIECE)):
        sums: list[int] = []
        for n, words in enumerate(zip(*found, strict=True)):
            # Only the last words of a text have fewer behind them.
            known = len(words) - next((i for i, w in enumerate(reversed(words)) if w is not None), len(words))
            sums = list(map(zlib.crc32, words[:known], sums) if n else map(zlib.crc32, words))
            yield sums


def bucket_counts(data: bytes, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[int, int, np.ndarray, np.ndarray]:
    """n_words, n_features, the buckets met and their counts."""
    total, words, features = np.zeros(buckets, np.int64), 0, 0
    for i, sums in enumerate(checksums(data, longest)):
        total += np.bincount(np.array(sums, np.uint32) % np.uint32(buckets), minlength=buckets)
        words += len(sums) if i % longest == 0 else 0
        features += len(sums)
    met = np.flatnonzero(total)
    return words, features, met.astype(np.int32), total[met].astype(np.int32)


def with_buckets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Adds n_words, n_features, and the met buckets with their counts, to each row."""

    def columns(texts: list[bytes]) -> dict:
        rows = [bucket_counts(x, longest, buckets) for x in texts]
        return {name: [r[i] for r in rows] for i, name in enumerate(("n_words", "n_features", "buckets", "counts"))}

    return map_texts(docs, columns, "n_words bigint, n_features bigint, buckets array<int>, counts array<int>", text, keep)


def bucket_totals(bucketed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all rows of with_buckets(). Each task sends a row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(total, at, n.astype(np.int64))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": met.astype(np.int32), "n": total[met]})

    return bucketed.select("buckets", "counts").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths: the log ratio of its smoothed shares in target and corpus, rounded down. The driver gets `buckets` rows."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    every = both.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))
    each = both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    sums = Window.partitionBy()  # over `buckets` rows
    whole = each.select("bucket", "s", "t", F.sum("s").over(sums).alias("s_all"), F.sum("t").over(sums).alias("t_all"))
    ratio = ((F.col("t") + 1) * (F.col("s_all") + buckets)) / ((F.col("s") + 1) * (F.col("t_all") + buckets))
    return [r.gain for r in whole.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def with_weight(bucketed: DataFrame, gain: list[int]) -> DataFrame:
    """The columns of `bucketed` with weight in place of buckets and counts."""
    kept = [c for c in bucketed.columns if c not in ("buckets", "counts")]
    source = bucketed.select(*[F.col(f"`{c}`") for c in kept], "buckets", "counts")
    each = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column(len(kept)), batch.column(len(kept) + 1)
            parts = each[at.flatten().to_numpy(zero_copy_only=False)] * n.flatten().to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(parts)])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in at])])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(upto[ends[1:]] - upto[ends[:-1]])], [*kept, "weight"])

    return source.mapInArrow(run, source.select(*[f"`{c}`" for c in kept]).schema.add("weight", "long"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def with_rank(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank to the rows of `scored` (doc_id, n_words, score): 1, 2, 3... by falling score, then doc_id, among rows of `least_words` words or more; null for those not drawn.

    `scored` is read twice, so let it be a written table. The rows above a score are
    summed over blocks of scores, then inside each block.
    """
    able = F.col("n_words") >= least_words
    cells = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("score") / BLOCK))
    cells = materialize(cells, "scores")
    higher = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("block").agg(F.sum("n").alias("m")).select("block", F.coalesce(F.sum("m").over(higher), F.lit(0)).alias("above"), F.sum("m").over(Window.partitionBy()).alias("all_rows"))
    inside = Window.partitionBy("block").orderBy(F.col("score").desc())
    above = cells.join(blocks.hint("merge"), "block").select("score", (F.sum("n").over(inside) - F.col("n") + F.col("above")).alias("__above"), F.expr(f"{percent} * all_rows div 100").alias("__drawn"))
    above = materialize(above.where("__above < __drawn"), "drawn_scores")
    met = scored.join(above.hint("merge"), "score", "left")
    ties = Window.partitionBy("score", able).orderBy("doc_id")
    rank = F.col("__above") + F.row_number().over(ties)
    return met.withColumn("__rank", rank).select(*[F.col(f"`{c}`") for c in scored.columns if c != "rank"], F.when(able & (F.col("__rank") <= F.col("__drawn")), F.col("__rank")).alias("rank"))


def resampled(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = 42
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of `docs`, drawn towards the texts of `target`."""
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    bucketed = materialize(with_buckets(named, "text", ["doc_id"], longest, buckets), "buckets")
    aims = with_buckets(target, text, [], longest, buckets)
    weighed = with_weight(bucketed, gains(bucket_totals(bucketed, buckets), bucket_totals(aims, buckets), buckets))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    return with_rank(scored, percent, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`, 5 % of them drawn towards the texts of `benchmark`."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
