"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

Method: every document starts at a rate of one copy, and no document may exceed
two. Among all rates that give each source its target number of words, those
nearest the start in (bounded) entropy are exponentially tilted:
r / (2 - r) = exp(lambda * size / mean size), with one multiplier a source. The
dual in lambda is convex; Newton steps solve it for all sources at once. A step
is one aggregation over (source, size, documents) cells, which is all that the
dual depends on; steps leaving the bracket known to hold the root are replaced by
its middle.

Rates then become copies. Cells of a source in descending order of size are
rounded on their running sum of copies, which keeps the words within half of the
largest document; passes over ever smaller documents then add or drop copies that
still fit into what is missing, until none does. The copies of a cell are dealt to
its documents by hash, in pieces whose number grows with the corpus, so no source or
cell meets in one task; rows that are equal in every column are counted first and
get their copies together. Texts move once, to meet their copies on a hash of the row.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share
150 % of all words; a target stops at twice its source's words, and the excess is
shared again by weight among the rest, until none is above.

Defined cases: a null source is a source; null texts, and texts without words,
have size 0 and are taken 0 words; a source without words has target 0; repeated
rows are documents of their own, and get copies in an order that their contents
alone decide; an empty table gives an empty result; columns named as a result give
way to it in with_copies and stay in mixed; maps are told apart by their JSON. Steps or passes
that don't settle raise an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hashable, in_pieces, materialize, table

MOST = 2  # copies of a document
PIECE_ROWS = 1 << 20  # a hot cell has a piece for each so many rows of the corpus, 32 at least
STEPS, STEPS_A_WRITE = 64, 4
PASSES, PASSES_A_WRITE = 96, 3
RUN_ROWS = 1 << 16  # equal rows that a task writes out


def word_count(text: str = "text"):
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """skey, source_size, target. sizes: skey, source, source_size, a row for each source.

    Filling by weight under the caps: in order of cap / weight, the first source
    that a common level does not fill sets the level for itself and all after it.
    The windows run over a row for each source.
    """
    every = Window.partitionBy()
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((k - 1) % len(weights)) + 1)
    s = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(MOST)) * F.col("source_size")).withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "skey")
    s = s.withColumn("rank", F.row_number().over(order))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - before) / from_here)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(every)
    s = s.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("first.level")))
    return s.select("skey", "source_size", target.alias("target"))


def _step(state: DataFrame, cells: DataFrame, tolerance: float) -> DataFrame:
    """One Newton step of every source that is still off."""
    rated = cells.join(state.select("skey", "lam", "mean").hint("merge"), "skey").withColumn("x", F.col("size") / F.col("mean"))
    p = 1 / (1 + F.exp(-F.col("lam") * F.col("x")))
    words = F.col("n") * F.col("size") * MOST
    sums = rated.select("skey", (words * p).alias("g"), (words * F.col("x") * p * (1 - p)).alias("h")).groupBy("skey").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    now = state.join(sums.hint("merge"), "skey").withColumn("off", F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("g") - F.col("target")))
    now = now.withColumn("lo", F.when(F.col("off") < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("off") > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
    step = F.when(F.col("h") > 0, F.greatest(F.lit(-4.0), F.least(F.lit(4.0), -F.col("off") / F.col("h")))).otherwise(-F.signum("off"))
    newton = F.col("lam") + step
    outside = (F.col("lo").isNotNull() & (newton <= F.col("lo"))) | (F.col("hi").isNotNull() & (newton >= F.col("hi")))
    middle = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2).otherwise(newton)
    done = F.abs("off") <= F.greatest(F.lit(0.5), F.lit(tolerance) * F.col("target"))
    now = now.withColumn("done", done)
    return now.select("skey", "target", "mean", "full", F.when(F.col("done"), F.col("lam")).when(outside, middle).otherwise(newton).alias("lam"), "lo", "hi", "done")


def tilts(cells: DataFrame, wanted: DataFrame, steps: int = STEPS, tolerance: float = 1e-4) -> DataFrame:
    """skey, lam, mean, full, target: the multipliers. cells: skey, size, n with size > 0; wanted: skey, source_size, target.

    Every few steps a row for each source goes to the shared folder; the driver sees only whether
    any source is off by more than half a word or `tolerance` of its target, and raises if one stays so.
    """
    n_docs = cells.groupBy("skey").agg(F.sum("n").alias("docs"))
    state = wanted.join(n_docs, "skey").select(
        "skey", "target", (F.col("source_size") / F.col("docs")).alias("mean"), (F.col("target") >= MOST * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
    )
    state = materialize(state, "tilts")
    for _ in range(0, steps, STEPS_A_WRITE):
        for _ in range(STEPS_A_WRITE):
            state = _step(state, cells, tolerance)
        state = materialize(state, "tilts")
        if state.where("not done").isEmpty():
            return state.select("skey", "lam", "mean", "full", "target")
    raise RuntimeError(f"the tilts did not settle in {steps} Newton steps")


def _free() -> Column:
    """How many copies of a cell can still be added, or dropped, without going past the target."""
    return F.when(F.col("size") > F.abs("miss"), F.lit(0)).when(F.col("miss") > 0, F.col("n") * MOST - F.col("k")).otherwise(F.col("k")).cast("long")


def cell_copies(cells: DataFrame, tilted: DataFrame, passes: int = PASSES) -> DataFrame:
    """skey, size, n, copies: how many copies the n documents of a cell get together, 0 to 2n.

    A source's cells, one for each size it has, are sorted in one task: as many rows as there are different
    lengths, whatever the number of documents. A pass takes the largest cells that fit, and at least halves what
    is missing, so that passes end when no document fits any more.
    """
    down = Window.partitionBy("skey").orderBy(F.col("size").desc())
    whole = Window.partitionBy("skey")
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    c = cells.join(tilted.hint("merge"), "skey").withColumn("rate", F.when(F.col("full"), F.lit(float(MOST))).otherwise(MOST / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("mean")))))
    run = F.sum(F.col("n") * F.col("rate")).over(upto)
    c = c.withColumn("run", F.floor(run + 0.5)).withColumn("k", F.col("run") - F.coalesce(F.lag("run").over(down), F.lit(0)))
    c = c.withColumn("k", F.greatest(F.lit(0), F.least(F.col("k"), F.col("n") * MOST)).cast("long"))
    missing = F.round(F.col("target")).cast("long") - F.sum(F.col("k") * F.col("size")).over(whole)
    c = c.select("skey", "size", "n", "target", "k").withColumn("miss", missing)
    for _ in range(0, passes, PASSES_A_WRITE):
        for _ in range(PASSES_A_WRITE):
            c = c.withColumn("free", _free())
            earlier = F.coalesce(F.sum(F.col("free") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            fits = F.greatest(F.lit(0), F.least(F.col("free"), F.floor((F.abs("miss") - earlier) / F.col("size")))).cast("long")
            c = c.withColumn("k", F.col("k") + F.signum("miss").cast("long") * fits).withColumn("miss", missing)
        c = materialize(c.select("skey", "size", "n", "target", "k", "miss"), "copies")
        if c.where(_free() > 0).isEmpty():
            return c.select("skey", "size", "n", F.col("k").alias("copies"))
    raise RuntimeError(f"the copies did not settle in {passes} passes")


def _share(upto, copies, n):
    """floor(upto * copies / n) for 0 <= upto <= n, without large products."""
    return upto * F.floor(copies / n) + F.floor(upto * (copies % n) / n)


_KEY = ("__o1", "__o2")  # two hashes of all columns tell rows apart


def _runs(rows: DataFrame, weights: Sequence[float], share: float) -> tuple[DataFrame, DataFrame]:
    """Targets by source; and __o1, __o2, __n, __k: the n equal rows of a hash get k copies together, rows without any left out.

    rows: skey, source, size and the two hashes of every document.
    """
    orders = materialize(rows.groupBy("skey", "source", "size", *_KEY).agg(F.count(F.lit(1)).alias("__n")), "orders")
    by_source = orders.groupBy("skey", "source").agg(F.sum(F.col("__n") * F.col("size")).alias("source_size"))
    wanted = materialize(targets(by_source, weights, share), "targets")
    worded = orders.where("size > 0").withColumn("piece", F.pmod("__o1", F.lit(max(32, orders.count() // PIECE_ROWS))))
    pieces = materialize(worded.groupBy("skey", "size", "piece").agg(F.sum("__n").alias("n_piece")), "pieces")
    cells = materialize(pieces.groupBy("skey", "size").agg(F.sum("n_piece").alias("n")), "cells")
    copies = cell_copies(cells, tilts(cells, wanted))
    along = Window.partitionBy("skey", "size").orderBy("piece")
    dealt = pieces.join(copies.hint("merge"), ["skey", "size"]).withColumn("upto", F.sum("n_piece").over(along))
    k_piece = _share(F.col("upto"), F.col("copies"), F.col("n")) - _share(F.col("upto") - F.col("n_piece"), F.col("copies"), F.col("n"))
    dealt = materialize(dealt.select("skey", "size", "piece", "n_piece", k_piece.alias("k_piece")).where("k_piece > 0"), "dealt")
    inside = Window.partitionBy("skey", "size", "piece").orderBy(*_KEY)
    met = worded.join(dealt.hint("merge"), ["skey", "size", "piece"]).withColumn("end", F.sum("__n").over(inside))
    k = _share(F.col("end"), F.col("k_piece"), F.col("n_piece")) - _share(F.col("end") - F.col("__n"), F.col("k_piece"), F.col("n_piece"))
    return wanted, materialize(met.select(*_KEY, "__n", k.cast("int").alias("__k")).where("__k > 0"), "runs")


def _marked(docs: DataFrame, source: str, words: Column, hashed: Sequence[Column]) -> DataFrame:
    """Adds __skey, __words and the two hashes of the columns `hashed`."""
    skey = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))
    return docs.select("*", skey.alias("__skey"), words.alias("__words"), F.xxhash64(*hashed).alias("__o1"), F.xxhash64(F.lit(1), *hashed).alias("__o2"))


def with_copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, source: str = "source", text: str = "text", size: str | None = None) -> DataFrame:
    """Adds size, source_size, target and copies (0 to 2) to the rows of `docs`.

    size: a column that has the words already; else they are counted. `docs` is
    read twice, and its columns decide the order of rows.
    """
    names = docs.columns
    rows = _marked(docs, source, word_count(text) if size is None else F.col(f"`{size}`"), hashable(docs))
    wanted, runs = _runs(rows.select(F.col("__skey").alias("skey"), F.col(f"`{source}`").alias("source"), F.col("__words").alias("size"), *_KEY), weights, share)
    w = wanted.select(F.struct("*").alias("__w"))
    met = rows.join(runs.hint("merge"), list(_KEY), "left").join(w, F.col("__skey") == F.col("__w.skey"), "left")
    kept = [F.col(f"`{c}`") for c in names if c not in ("size", "source_size", "target", "copies")]
    out = lambda df, copies: df.select(*kept, F.col("__words").alias("size"), F.col("__w.source_size").alias("source_size"), F.col("__w.target").alias("target"), copies.alias("copies"))
    once = out(met.where("__n IS NULL OR __n = 1"), F.coalesce("__k", F.lit(0)))
    if runs.where("__n > 1").isEmpty():
        return once
    # Equal rows are counted, and come back as many, the first ones with a copy more.
    whole = F.struct(*[F.col(c) if c[:2] == "__" else F.col(f"`{c}`") for c in met.columns])
    runs_of = met.where("__n > 1").groupBy(*_KEY).agg(F.any_value(whole).alias("__row")).select(F.col("__row.__n").alias("__n"), F.col("__row.__k").alias("__k"), *[F.col(f"__row.{c}").alias(c) for c in _KEY], "__row")
    equal = in_pieces(F.lit(1).cast("long"), F.col("__n"), RUN_ROWS, *_KEY)(runs_of).select(F.col("number").alias("__i"), "__row").select("__i", "__row.*")
    more = F.floor(F.col("__k") / F.col("__n")) + F.when(F.col("__i") <= F.col("__k") % F.col("__n"), 1).otherwise(0)
    return once.unionByName(out(equal, more.cast("int")))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, source: str = "source", text: str = "text") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it. Documents without words are taken no times."""
    quoted = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*quoted).alias("__doc"), F.col(f"`{source}`").alias("__source"), word_count(text).alias("__size"))
    whole = whole.withColumn("__hashed", F.struct(*hashable(whole.select("__doc"))))
    rows = _marked(whole, "__source", F.col("__size"), [F.col("__hashed")]).drop("__hashed")
    _, runs = _runs(rows.select(F.col("__skey").alias("skey"), F.col("__source").alias("source"), F.col("__words").alias("size"), *_KEY), weights, share)
    taken = rows.select("__doc", *_KEY).join(runs.hint("merge"), list(_KEY))
    once = taken.where("__n = 1").select("__doc", F.explode(F.sequence(F.lit(1), "__k"))).select("__doc.*")
    if runs.where("__n > 1").isEmpty():
        return once
    equal = taken.where("__n > 1").groupBy(*_KEY).agg(F.any_value("__doc").alias("__doc"), F.any_value("__k").alias("__k"))
    return once.unionByName(in_pieces(F.lit(1).cast("long"), F.col("__k").cast("long"), RUN_ROWS, *_KEY)(equal).select("__doc.*"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    slim = materialize(table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("n")), "words")
    return with_copies(slim, size="n").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
