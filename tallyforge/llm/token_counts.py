"""Token counts: exact histogram of encoded lengths, with suffix sums that answer every context limit.

Method: each whole text is encoded with a public vocabulary; documents are then
aggregated by encoded length. Suffix sums over the histogram give, for any
context limit, the total tokens, the tokens left when every document is cut
there, and quantiles. Only the histogram is shuffled: one row for each length
that a task met.

Defined cases: a null or empty text has length 0 and counts as a document;
repeated rows count each; an empty table gives an empty histogram; columns other
than the text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, table

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Lengths are summed in blocks of this many, then within each block.
BLOCK = 256


def split_pattern(folder: str) -> str:
    """The pre-tokenizer pattern that belongs to the vocabularies of `folder`."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("tallyforge_public_tokenizers", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


@lru_cache(maxsize=4)
def encoder(path: str):
    """A byte-level BPE encoder from a file of ranks; built once in each Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=split_pattern(path.rpartition("/")[0]), mergeable_ranks=ranks, special_tokens={})


def with_length(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, keep: Sequence[str] = ()) -> DataFrame:
    """The columns `keep` and `length`, the tokens of the whole text (null: 0)."""

    def lengths(texts: list[bytes]) -> dict:
        encode = encoder(vocabulary).encode_ordinary
        return {"length": [len(encode(x.decode("utf-8", "replace"))) for x in texts]}

    return map_texts(docs, lengths, "length bigint", text, keep)


def histogram(lengths: DataFrame) -> DataFrame:
    """length, n_docs: the documents of each encoded length. Summed in each task before the shuffle."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length: documents and tokens of that length and longer, and what a cut at this length leaves.

    Sums run in two levels: over blocks of lengths (as many as the longest
    document has tokens / `block`), then inside each block, so no task sorts the
    whole histogram. Returns length, n_docs, n_tokens, docs_from, tokens_from,
    docs_upto, total_docs, total_tokens, truncated_tokens.
    """
    cells = hist.withColumn("n_tokens", F.col("n_docs") * F.col("length")).withColumn("block", F.floor(F.col("length") / block))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(Window.partitionBy()).alias("total_docs"),
        F.sum("t").over(Window.partitionBy()).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc())
    return (
        cells.join(blocks.hint("shuffle_hash"), "block")
        .withColumn("docs_from", F.sum("n_docs").over(within) + F.col("d_after"))
        .withColumn("tokens_from", F.sum("n_tokens").over(within) + F.col("t_after"))
        .select(
            "length", "n_docs", "n_tokens", "docs_from", "tokens_from",
            (F.col("total_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
            "total_docs", "total_tokens",
            (F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
        )
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, docs_cut, truncated_tokens for any limits, whether or not a document has that length.

    A limit takes the suffix sums of the next length met: one pass, an aggregate
    for each limit. An empty table answers nulls.
    """
    nexts = [F.min(F.when(F.col("length") > n, F.struct("length", "docs_from", "tokens_from"))).alias(f"n{i}") for i, n in enumerate(limits)]
    one = sums.agg(F.max("total_tokens").alias("total"), *nexts)
    rows = [
        F.struct(
            F.lit(int(n)).cast("long").alias("context_limit"),
            F.coalesce(F.col(f"n{i}.docs_from"), F.col("total") * 0).alias("docs_cut"),
            F.coalesce(F.col("total") - F.col(f"n{i}.tokens_from") + F.lit(int(n)) * F.col(f"n{i}.docs_from"), F.col("total")).alias("truncated_tokens"),
        )
        for i, n in enumerate(limits)
    ]
    return one.select(F.inline(F.array(*rows)))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, length: the smallest length that at least this share of the documents does not exceed."""
    found = [F.min(F.when(F.col("docs_upto") >= F.ceil(F.col("total_docs") * F.lit(float(q))), F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    rows = [F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)]
    return sums.agg(*found).select(F.inline(F.array(*rows)))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all `documents` with its suffix sums: a row for every context limit that is some document's length."""
    return suffix_sums(materialize(histogram(with_length(table(spark, sf_dir, "documents"))), "lengths"))
