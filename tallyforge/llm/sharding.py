"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

Method: the ring has 2^14 cells. Each shard owns `vnodes` points on it; the cells
up to a point, clockwise, are that point's arc, and a row's home is the shard of
the arc its key hashes to. A shard takes rows up to its capacity. Rows beyond it
continue clockwise to the next point whose shard has room; nearer points are
served first. With capacities of the floor or ceiling of rows / shards, counts
differ by at most one; with slack they stay below (1 + slack) times the mean, and
fewer rows leave home.

What the driver plans with is the row count of each arc, which is bounded by the
number of points. It yields segments: a range of an arc's rows, its shard, and the
slot of its first row. Rows are numbered inside small pieces of the ring (a cell
and a hash of the whole row), and pieces are offset by sums over their arc, so no
key, however frequent, meets in one task: rows that are equal in every column are
counted before the shuffle and numbered as a run. The number of pieces of a cell
grows with the table, so a key with a third of the rows still has pieces of bounded size.

Defined cases: keys may be null and may repeat; a null text has size 1; an empty
table gives an empty result; equal rows take neighbouring slots, in the one task that
has their run; columns named as a result give way to it.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

CELLS = 1 << 14
PIECE_ROWS = 1 << 24  # a cell has a piece, by a hash of the row, for each so many rows of the table, 16 at least
RUN_ROWS = 1 << 16  # equal rows that are numbered and written out together
VNODES = 64


def ring(spark: SparkSession, shards: int, vnodes: int = VNODES) -> DataFrame:
    """cell, arc, shard: the arc of every cell, and its shard. Arcs are numbered clockwise; a point's place depends on its shard and number alone."""
    points = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("v"))
    points = points.select("shard", F.pmod(F.xxhash64(F.lit("point"), "shard", "v"), F.lit(CELLS)).cast("int").alias("cell"))
    # If points meet in a cell, the one with the smallest shard has it.
    points = points.groupBy("cell").agg(F.min("shard").alias("shard"))
    clockwise = Window.orderBy("cell")
    arcs = points.withColumn("arc", F.row_number().over(clockwise) - 1).withColumn("after", F.lag("cell", 1, -1).over(clockwise)).withColumn("last", F.max("cell").over(Window.partitionBy()))
    own = arcs.select("arc", "shard", F.explode(F.sequence(F.col("after") + 1, "cell")).alias("cell"))
    # Past the last point the ring goes on to the first one.
    rest = arcs.where("arc = 0 and last < %d" % (CELLS - 1)).select("arc", "shard", F.explode(F.sequence(F.col("last") + 1, F.lit(CELLS - 1))).alias("cell"))
    return own.unionByName(rest).select("cell", "arc", "shard")


def allot(loads: list[int], owners: list[int], capacities: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first row, shard, rows) of all arcs. Distance 0 is served before distance 1 and so on, arcs clockwise within each."""
    left = list(loads)
    taken = [0] * len(loads)
    room = dict(capacities)
    out = []
    waiting = [a for a, n in enumerate(left) if n]
    for distance in range(len(loads)):
        if not waiting:
            break
        for a in waiting:
            shard = owners[(a + distance) % len(owners)]
            n = min(left[a], room[shard])
            if n:
                out.append((a, taken[a], shard, n))
                taken[a] += n
                left[a] -= n
                room[shard] -= n
        waiting = [a for a in waiting if left[a]]
    if waiting:
        raise ValueError("capacities are below the number of rows")
    return out


def capacities(rows: int, shards: int, slack: float) -> dict[int, int]:
    """Without slack, the floor of rows / shards and one more for the first ones; else the ceiling of (1 + slack) times the mean."""
    if slack:
        return dict.fromkeys(range(shards), -int(-(1 + slack) * rows // shards))
    return {s: rows // shards + (s < rows % shards) for s in range(shards)}


def with_shard(df: DataFrame, key: str | Column, shards: int, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """Adds home_shard, shard and slot (gapless from 0 in each shard) to the rows of `df`; columns of these names give way.

    Every column of `df` takes part in the order of rows, so bring no more than
    are needed; it is read twice, and counted. Maps are not allowed.
    """
    pieces_of_cell = max(16, -(-df.count() // PIECE_ROWS))
    spark, names = df.sparkSession, [c for c in df.columns if c not in ("home_shard", "shard", "slot")]
    quoted = [F.col(f"`{c}`") for c in names]
    rows = (
        df.withColumn("__cell", F.pmod(F.xxhash64(F.lit("key"), F.col(f"`{key}`") if isinstance(key, str) else key), F.lit(CELLS)).cast("int"))
        .withColumn("__order", F.xxhash64(*quoted))
        .groupBy("__cell", "__order", *quoted)
        .agg(F.count(F.lit(1)).alias("__all"))
        # A run of equal rows is cut into parts, which go to pieces of their own.
        .withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__all") - 1) / RUN_ROWS))))
        .withColumn("__n", F.least(F.lit(RUN_ROWS).cast("long"), F.col("__all") - F.col("__part") * RUN_ROWS))
        .withColumn("__piece", F.pmod(F.xxhash64(*quoted, F.lit(1), F.col("__part")), F.lit(pieces_of_cell)).cast("int"))
    )
    places = materialize(ring(spark, shards, vnodes).withColumnsRenamed({"cell": "__cell", "arc": "__arc", "shard": "home_shard"}), "ring")
    pieces = materialize(rows.groupBy("__cell", "__piece").agg(F.sum("__n").alias("__rows")).join(F.broadcast(places), "__cell"), "pieces")  # CELLS rows are broadcast
    owner_of = {r["__arc"]: r["home_shard"] for r in places.select("__arc", "home_shard").distinct().collect()}  # a row for each point of the ring
    load_of = {r["__arc"]: r["n"] for r in pieces.groupBy("__arc").agg(F.sum("__rows").alias("n")).collect()}
    owners = [owner_of[a] for a in range(len(owner_of))]
    segments = allot([load_of.get(a, 0) for a in range(len(owners))], owners, capacities(sum(load_of.values()), shards, slack))
    used: dict[int, int] = {}
    planned = []
    for arc, first, shard, n in sorted(segments):
        planned.append((arc, first, first + n, shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + n
    plan = spark.createDataFrame(planned, "__arc int, __first long, __end long, shard int, __slot long")

    around = Window.partitionBy("__arc").orderBy("__cell", "__piece")
    offsets = pieces.withColumn("__offset", F.sum("__rows").over(around) - F.col("__rows")).drop("__rows")
    inside = Window.partitionBy("__cell", "__piece").orderBy("__order", *quoted, "__part")
    numbered = rows.withColumn("__at", F.sum("__n").over(inside) - F.col("__n")).join(offsets.hint("merge"), ["__cell", "__piece"])
    # A run of equal rows may reach over the end of a segment, so it meets each segment that it overlaps.
    start = F.col("__offset") + F.col("__at")
    numbered = numbered.withColumn("__start", start).withColumn("__stop", start + F.col("__n"))
    met = numbered.join(F.broadcast(plan), ["__arc"]).where((F.col("__start") < F.col("__end")) & (F.col("__stop") > F.col("__first")))
    low, high = F.greatest("__start", "__first"), F.least("__stop", "__end")
    slot = F.col("__slot") + low - F.col("__first")
    return met.select(*quoted, "home_shard", "shard", F.explode(F.sequence(slot, slot + high - low - 1)).alias("slot"))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32 (of a null text: 0)."""
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 16, vnodes: int = VNODES, slack: float = 0.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, home_shard, shard, slot of all rows, by the ring position of doc_id."""
    return with_shard(sized(docs, doc_id, text), "doc_id", shards, vnodes, slack)


def contract(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose counts differ by at most one."""
    return contract(shard_documents(table(spark, sf_dir, "documents")))
