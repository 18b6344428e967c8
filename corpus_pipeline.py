"""The corpus pipeline: five stages over `documents`, each written as Parquet and read back for the next.

quality rules, near-dedup by word shingles, benchmark decontamination, mixing sources to
target weights, sharding. Every stage works on all rows its predecessor kept; all
but the last return the columns of documents.

Defined cases: null, empty and blank texts, and texts below 50 words, go in the first
stage; equal texts and rows that repeat a doc_id leave one row; a null source is a
source; extra columns travel along, whatever their names, maps too; a
stage that keeps nothing, or an empty table, gives
an empty result; without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import materialize, table
from tallyforge.llm.decontaminate import without_contaminated
from tallyforge.llm.mixing import mixed
from tallyforge.llm.quality import passing
from tallyforge.llm.sharding import contract, shard_documents
from tallyforge.llm.shingle_sets import one_of_each


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return passing(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more on 5-word shingles): the one with the smallest doc_id."""
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: a row for each copy, none for 0."""
    return mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row, in 16 shards."""
    return contract(shard_documents(docs))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# SimHash with covering tables, bands of MinHash values, winnowing and Newton steps aren't expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
