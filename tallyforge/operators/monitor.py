"""Checks of catalogues, comparison of results, and run statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import settle, small


def coverage_gaps(catalog: DataFrame, mapping: DataFrame, key: str = "carrera") -> DataFrame:
    """Entries of the catalogue that the mapping lacks, sorted."""
    return catalog.select(key).distinct().join(mapping.select(key), key, "left_anti").orderBy(key)


def mapping_profile(mapping: DataFrame, a: str = "publica", b: str = "privada") -> DataFrame:
    """How many entries map to only a, only b, or both."""
    has = lambda v: F.max(F.col("institucion") == v)
    g = mapping.groupBy("carrera").agg(has(a).alias("a"), has(b).alias("b"))
    return g.agg(F.count_if(F.col("a") & ~F.col("b")).alias("solo_publica"), F.count_if(~F.col("a") & F.col("b")).alias("solo_privada"), F.count_if(F.col("a") & F.col("b")).alias("ambas"))


def compare_results(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """columna, iguales, distintos, solo_a, solo_b for every column that isn't a key; nulls are equal to each other."""
    values = [c for c in a.columns if c not in keys]
    side = lambda df, x: df.select(*keys, F.struct(*values).alias(x))
    j = side(a, "x").join(side(b, "y"), list(keys), "full")
    only_a, only_b = F.count_if(F.col("y").isNull()).alias("solo_a"), F.count_if(F.col("x").isNull()).alias("solo_b")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    counts = [F.count_if(both & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).alias(f"e{i}") for i, c in enumerate(values)]
    g = j.agg(F.count_if(both).alias("n"), only_a, only_b, *counts)
    rows = [F.struct(F.lit(c).alias("columna"), F.col(f"e{i}").alias("iguales"), (F.col("n") - F.col(f"e{i}")).alias("distintos"), "solo_a", "solo_b") for i, c in enumerate(values)]
    return g.select(F.inline(F.array(*rows)))


def value_at_rank(values: DataFrame, wanted: DataFrame, by: str, value: str, buckets: int = 4096, held: int = 10_000) -> DataFrame:
    """by, rank and the value at that rank (from 1, ascending) of its group. values: by, value, without nulls; wanted: by, rank, lo, hi, the least and largest value of the group.

    Each round counts the values by bucket between lo and hi, in each task before the shuffle, and goes on inside the bucket
    that holds the rank. Once no such bucket has more than `held` values, or it has one value many times, they are sorted. No
    task gets more than that, however many values a group has.
    """
    at, state = F.col(value).cast("double"), wanted.select(by, "rank", F.col("lo").cast("double"), F.col("hi").cast("double"), F.lit(0).cast("long").alias("before"))
    order = Window.partitionBy(by, "rank").orderBy("bucket")

    def inside(state: DataFrame) -> DataFrame:
        own = values.select(F.col(by).alias("__by"), at.alias("v"))
        within = F.col("__by").eqNullSafe(F.col(by)) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        return own.join(small(state), within).drop("__by")

    while True:
        # Halved first, so that a range of any two doubles has a width.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.lit(buckets - 1), F.floor(share * buckets)))
        counts = inside(state).groupBy(by, "rank", "before", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = counts.withColumn("upto", F.col("before") + F.sum("n").over(order)).where(F.col("upto") >= F.col("rank"))
        first = upto.withColumn("r", F.row_number().over(order)).where("r = 1")
        state = settle(first.select(by, "rank", "lo", "hi", (F.col("upto") - F.col("n")).alias("before"), "n"), "ranks")
        if state.where((F.col("n") > held) & (F.col("lo") < F.col("hi"))).isEmpty():
            break
        state = state.drop("n")
    known = state.where("lo = hi").select(by, "rank", F.col("lo").alias(value))
    rest = inside(state.where("lo < hi")).groupBy(by, "rank", "before").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return known.unionByName(rest.select(by, "rank", F.get("vs", (F.col("rank") - F.col("before") - 1).cast("int")).alias(value)))


def run_stats(log: DataFrame, by: str = "stage", value: str = "seconds") -> DataFrame:
    """n, media, mediana, minimo, maximo and the sample deviation (0 for a single run) of each stage. The median is found by counting, so a stage may have any number of runs."""
    v = F.col(value)
    stats = settle(log.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("media"), F.min(v).alias("minimo"), F.max(v).alias("maximo"), F.coalesce(F.when(F.count(v) >= 2, F.stddev_samp(v)), F.lit(0.0)).alias("desviacion")), "stats")
    middle = F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))).alias("rank")
    found = value_at_rank(log.where(v.isNotNull()), stats.where("n > 0").select(by, middle, F.col("minimo").alias("lo"), F.col("maximo").alias("hi")), by, value)
    medians = found.groupBy(F.col(by).alias("__by")).agg(F.avg(value).alias("mediana"))
    return stats.join(medians.hint("merge"), F.col(by).eqNullSafe(F.col("__by")), "left").select(by, "n", "media", "mediana", "minimo", "maximo", "desviacion")


def throughput(log: DataFrame, workers: Sequence[int] = (1, 2, 4, 8), value: str = "seconds") -> DataFrame:
    """trabajadores, por_segundo: workers over the mean run time."""
    mean = log.agg(F.avg(value).alias("m"))
    return mean.select(F.explode(F.array(*[F.lit(w) for w in workers])).alias("trabajadores"), "m").select("trabajadores", (F.col("trabajadores") / F.col("m")).alias("por_segundo"))


def missing_fields(df: DataFrame, required: Sequence[str], key: str, fields: str = "campos") -> DataFrame:
    """key and faltan, the required names that the record's map lacks or holds as null, sorted; complete records are left out."""
    present = F.map_keys(F.map_filter(F.col(fields), lambda k, v: v.isNotNull()))
    gone = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), present))
    return df.select(key, gone.alias("faltan")).where(F.size("faltan") > 0)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """tabla, n for each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tabla"), "n") for name, df in tables.items()])
