"""Shared pieces of the corpus operators: tables, shared storage and Arrow maps over whole texts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts may be long, so a batch sent to Python holds few rows.
BATCH_ROWS = 256
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, one of our own on a local master; on a cluster that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file:///tmp/tallyforge-{os.getuid()}/shared"
    return named.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back.

    The files survive lost executors, and Spark knows their true size when it
    plans the joins that follow.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's rows per Arrow batch to at most `rows`, so that a batch of long texts fits a worker."""
    if int(spark.conf.get(_BATCH_KEY)) > rows:
        spark.conf.set(_BATCH_KEY, str(rows))


def hashable(df: DataFrame) -> list[Column]:
    """The columns of `df`, those with a map in them as JSON, for hashes of whole rows: Spark doesn't hash maps."""
    has_map = lambda t: isinstance(t, T.MapType) or any(map(has_map, [t.elementType] if isinstance(t, T.ArrayType) else [f.dataType for f in t.fields] if isinstance(t, T.StructType) else []))
    return [F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields]


def in_pieces(first: Column, last: Column, rows: int, *spread: str):
    """For runs of equal rows: a function from a frame with a row for each run to one with a row, numbered `number` from first to last, for each of the run's rows.

    A run is cut at every `rows` numbers, and the pieces are dealt over tasks by the columns `spread`, so no task writes out a long run alone.
    """

    def written(runs: DataFrame) -> DataFrame:
        cut = runs.where(last >= first).withColumn("__from", F.explode(F.sequence(first, last, F.lit(rows).cast("long"))))
        dealt = cut.withColumn("__to", F.least(last, F.col("__from") + rows - 1)).repartition(*spread, "__from")
        return dealt.withColumn("number", F.explode(F.sequence("__from", "__to"))).drop("__from", "__to")

    return written


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, columns: Callable[[list[bytes]], dict[str, list]], added: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Append columns computed from whole texts to each row of `df`; no shuffle.

    columns: from the texts of a batch, a list for each added column.
    added: DDL of these columns. keep: columns of `df` to return (default all);
    a kept column with the name of an added one gives way to it.
    """
    small_batches(df.sparkSession)
    extra = T.StructType.fromDDL(added)
    names = [c for c in (df.columns if keep is None else keep) if c not in extra.names]
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = source.select(*[F.col(f"`{c}`") for c in names]).schema
    for field in extra.fields:
        schema = schema.add(field)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in extra.fields]
        for batch in batches:
            made = columns(texts_of(batch, "__text"))
            arrays = [pa.array(made[f.name], type=f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], schema=pa.schema([*list(batch.schema)[:-1], *fields]))

    return source.mapInArrow(run, schema)
