"""Source divergence audit: how far apart the term distributions of a language's sources are, and which terms set a source apart.

Method: bytes.translate lowers letters and blanks separators in one pass, bytes.split
gives the terms, and a Counter of each document their counts. These are added up by
(lang, source, term) in each task, in a table of bounded size, and sent on as sparse
rows. A language keeps the terms that enough of its documents have. Shares are
smoothed, in whole billionths, and all arithmetic is on whole numbers.

Pairs of sources are compared without writing out terms that neither or only one of
them has. Terms that a source lacks all have its least share, so with f the distance at
one term, the sum over all terms is (with p0, q0 the least shares)
    V f(p0, q0) + sum over p's terms (f(p, q0) - f(p0, q0)) + sum over q's terms (f(p0, q) - f(p0, q0))
    + sum over common terms (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).
The two sums in the middle run over distinct shares of a source, not over its terms.

Defined cases: null texts, languages and sources read as ''; a document without terms
still makes its group occur; a language without kept terms has pairs of value 0 and no
terms; a source that is alone in its language has no pairs; repeated rows count each; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import small
from .common import materialize, small_batches, table, texts_of

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
# Terms that a task holds before it sends them on.
HELD = 500_000
# What a document adds to a term's number; occurrences stay below it while they are held.
ONE_DOC = 1 << 36


def _letters_table() -> bytes:
    """A-Z to a-z; a-z and bytes of non-ASCII characters stay; every other byte to a space."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


LETTERS = _letters_table()


def terms(data: bytes) -> list[bytes]:
    """Matches of [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z lower-cased."""
    return data.translate(LETTERS).split()


class _Tally:
    """Documents and occurrences of each term by group, in one number; a group's None is its documents."""

    def __init__(self):
        self.groups: dict[tuple[bytes, bytes], dict] = defaultdict(dict)
        self.size = 0

    def add(self, group: tuple[bytes, bytes], data: bytes) -> None:
        each = Counter(terms(data))
        own = self.groups[group]
        self.size -= len(own)
        get = own.get
        for term, n in each.items():
            own[term] = get(term, 0) + n + ONE_DOC
        own[None] = get(None, 0) + ONE_DOC
        self.size += len(own)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in self.groups.items():
            both = np.fromiter(own.values(), np.int64, len(own))
            words = pa.array(own.keys(), pa.binary())
            try:
                words = words.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that aren't UTF-8
                words = pa.array([x if x is None else x.decode("utf-8", "replace") for x in own], pa.string())
            names = [pa.repeat(x.decode("utf-8", "replace"), len(own)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, words, pa.array(both // ONE_DOC), pa.array(both % ONE_DOC)], ["lang", "source", "term", "n_docs", "n"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n_docs, n over whole texts, several rows for a term of a source; a row with a null term has the documents of its group."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for group_lang, group_source, data in zip(*(texts_of(batch, c) for c in ("lang", "source", "text")), strict=True):
                tally.add((group_lang, group_source), data)
                if tally.size > HELD:
                    yield from tally.batches()
                    tally = _Tally()
        yield from tally.batches()

    named = docs.select(*[F.col(f"`{c}`").cast("string").alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    return named.mapInArrow(run, "lang string, source string, term string, n_docs bigint, n bigint")


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, held for each term that `least_docs` documents of its language have; held: source and n of the sources that have it. The row with a null term holds all sources of the language.

    Rows move once, to their term: both sums are made there.
    """
    placed = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    held = F.collect_list(F.struct("source", "n")).alias("held")
    return placed.groupBy("lang", "term").agg(F.sum("n_docs").alias("d"), F.sum("n").alias("total"), held).where(F.col("term").isNull() | (F.col("d") >= least_docs)).drop("d")


def group_sizes(langs_and_terms: DataFrame) -> DataFrame:
    """lang, source, kept (terms), lang_total, source_total, least (the share of a term that the source lacks; null without terms): a row for each group that occurs. langs_and_terms: of kept_terms()."""
    groups = langs_and_terms.where("term IS NULL").select("lang", F.explode("held.source").alias("source"))
    kept = langs_and_terms.where("term IS NOT NULL")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    totals = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("source_total"))
    met = groups.join(langs.hint("merge"), "lang", "left").join(totals.hint("merge"), ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    filled = met.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("kept", "lang_total", "source_total")])
    return filled.withColumn("least", F.when(F.col("kept") > 0, share(zero, F.col("source_total"), F.col("kept"))))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)); the product may exceed a long, so it is a decimal."""
    return 1 + F.call_function("div", (n + 2).cast("decimal(19,0)") * F.lit(SCALE), (total + 2 * kept).cast("decimal(19,0)"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, source, p, least, q: the shares of each kept term in the sources that have it, and in the language."""
    each = kept.select("lang", "term", "total", F.explode("held").alias("h")).select("lang", "term", "total", F.col("h.source").alias("source"), F.col("h.n").alias("n"))
    placed = each.join(small(groups), ["lang", "source"])
    return placed.select("lang", "term", "source", share(F.col("n"), F.col("source_total"), F.col("kept")).alias("p"), "least", share(F.col("total"), F.col("lang_total"), F.col("kept")).alias("q"))


def source_pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for both directions of each pair of sources of a language."""
    pair = lambda a, b: (F.least(a, b).alias("source"), F.greatest(a, b).alias("item"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("least").alias("other_least"))
    # No source has any of the terms.
    neither = groups.join(small(others), "lang").where(F.col("source") < F.col("other"))
    none = neither.select("lang", *pair("source", "other"), F.coalesce(F.col("kept") * distance(F.col("least"), F.col("other_least")), F.lit(0)).cast("long").alias("value"))
    # One source has a term: a row for each distinct share of the source.
    alike = shares.groupBy("lang", "source", "p", "least").agg(F.count(F.lit(1)).alias("n")).join(small(others), "lang").where(F.col("source") != F.col("other"))
    one = alike.select("lang", *pair("source", "other"), (F.col("n") * (distance(F.col("p"), F.col("other_least")) - distance(F.col("least"), F.col("other_least")))).alias("value"))
    # Both have it.
    held = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "least"))).alias("held"))
    first = held.select("lang", "held", F.posexplode("held").alias("at", "a"))
    both = first.select("lang", "a", F.explode(F.slice("held", F.col("at") + 2, F.size("held"))).alias("b"))
    p, p0, q, q0 = F.col("a.p"), F.col("a.least"), F.col("b.p"), F.col("b.least")
    two = both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), (distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)).alias("value"))
    sums = none.unionByName(one).unionByName(two).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both_ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return sums.select("lang", F.explode(both_ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def own_terms(shares: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the `top` terms that are more frequent in a source than in its language, by distance. Each task sends on no more than `top` rows of a source."""
    falling = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    more = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return more.withColumn("rank", F.row_number().over(falling)).where(F.col("rank") <= top)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair`, `term`), item, value, rank."""
    kept = materialize(kept_terms(term_counts(docs, text, lang, source), least_docs), "kept")
    groups = materialize(group_sizes(kept), "groups")
    shares = materialize(term_shares(kept.where("term IS NOT NULL"), groups), "shares")
    falling = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = source_pairs(shares, groups).withColumn("rank", F.row_number().over(falling))
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").unionByName(part(own_terms(shares, top), "term"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergence audit of all `documents`."""
    return audit(table(spark, sf_dir, "documents"))
