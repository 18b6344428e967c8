"""Tables in the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, below a folder of our own on a local master; on a cluster that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file:///tmp/tallyforge-{os.getuid()}/shared"
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def is_small(df: DataFrame, rows: int = 10_000) -> bool:
    """Whether `df` has at most so many rows, and so may be broadcast; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most so many rows, which are counted first; a larger one is merged."""
    return F.broadcast(df) if is_small(df, rows) else df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by these columns over as many tasks as the session's shuffles have. Narrow rows compress so well that tasks put together by their size hold too many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` and read it back: what several later joins need is computed once, survives lost executors, and has a known size."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
