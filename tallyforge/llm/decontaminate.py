"""Benchmark decontamination by winnowing.

Method: of every `window - gram + 1` consecutive k-gram hashes the least is kept
(the rightmost of equals). Any span of `window` words shared by a document and
an item then has a kept k-gram in common, at the same offset in both. Kept hashes
of documents are joined with those of the items; each hit is extended to both
sides by comparing words, and counts if it reaches `window` words. So no shared
window is missed, and none is reported that isn't equal word for word.

Items of fewer words than a window are one window themselves: documents give the
hashes of all their spans of these few lengths.

Documents first drop hashes that no item has, by a bit table of fixed size
(2 MB, whatever the benchmark's size), so little of the corpus is shuffled; the
join itself is on hashes, for benchmarks of any size. Fingerprints with the same
words around them are compared once for all documents and items that have them.

Defined cases: null or empty texts have no words, and items without words are no
window; equal items count each; rows that repeat a doc_id are rows of their own;
rows equal in doc_id and text share a result; an empty table on either side gives
no hits; a null item_id is left out of the list of ids; other columns do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, table
from .quality import _memo
from .words import gram_hashes, plain_words, word_hashes

WINDOW, GRAM = 10, 5
TABLE_BITS = 24
_CANDIDATE = "array<struct<kind: int, hash: bigint, at: int, ahead: int, words: array<string>>>"


def winnow(grams: np.ndarray, per: int) -> np.ndarray:
    """Positions of the least hash of every `per` consecutive ones, the rightmost of equals; of all, if there are fewer."""
    n = len(grams)
    if n == 0:
        return np.empty(0, np.int64)
    per = min(per, n)
    best, at = grams[: n - per + 1].copy(), np.arange(n - per + 1)
    for j in range(1, per):
        other = grams[j : j + len(best)]
        take = other <= best
        best = np.where(take, other, best)
        at = np.where(take, np.arange(j, j + len(best)), at)
    return np.unique(at)


def candidates(data: bytes, short: tuple[int, ...], bits: np.ndarray | None, window: int, gram: int, whole_short: bool) -> tuple[int, list]:
    """Word count, and the fingerprints of a text with the words around them.

    short: the lengths of items below a window. whole_short: the text is an item,
    so if it is short it is one window itself. bits: keep only hashes in this table.
    """
    words = plain_words(data)
    n = len(words)
    if n == 0:
        return 0, []
    hashes = word_hashes(words, _memo())
    out: list = []

    def add(kind: int, grams: np.ndarray, at: np.ndarray, before: int, after: int) -> None:
        picked = grams[at]
        if bits is not None:
            slot = picked >> np.uint64(64 - TABLE_BITS)
            known = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
            at, picked = at[known == 1], picked[known == 1]
        for p, h in zip(at.tolist(), picked.view(np.int64).tolist(), strict=True):
            first = max(0, p - before)
            out.append({"kind": kind, "hash": h, "at": p, "ahead": p - first, "words": [w.decode("utf-8", "replace") for w in words[first : p + after]]})

    if n >= window:
        grams = gram_hashes(hashes, gram)
        add(0, grams, winnow(grams, window - gram + 1), window - gram, window)
    for m in {n} if whole_short and n < window else () if whole_short else short:
        if m <= n:
            grams = gram_hashes(hashes, m)
            add(m, grams, np.arange(len(grams)), 0, m)
    return n, out


def fingerprinted(df: DataFrame, keep: list[str], text: str, short: tuple[int, ...], bits: np.ndarray | None, window: int, gram: int, whole_short: bool) -> DataFrame:
    """Adds n_words and found, the candidate fingerprints of each row."""

    def columns(texts: list[bytes]) -> dict:
        rows = [candidates(x, short, bits, window, gram, whole_short) for x in texts]
        return {"n_words": [r[0] for r in rows], "found": [r[1] for r in rows]}

    return map_texts(df, columns, f"n_words bigint, found {_CANDIDATE}", text, keep)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Bit per hash prefix: 2^TABLE_BITS bits at most, or-ed together in Spark by 64-bit groups; the driver gets the groups that have bits."""
    slot = F.shiftrightunsigned("hash", 64 - TABLE_BITS)
    groups = hashes.select(F.shiftright(slot, 6).cast("int").alias("g"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - TABLE_BITS}) & 63 as int))").alias("b"))
    out = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for g, b in groups.groupBy("g").agg(F.bit_or("b")).toLocalIterator():
        out[g] = b
    return out.view(np.uint8)


def _run(a, b, reverse: bool):
    """Number of equal leading elements of two arrays of words."""
    if reverse:
        a, b = F.reverse(a), F.reverse(b)
    same = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"].eqNullSafe(z["y"]) & z["x"].isNotNull())
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _places(df: DataFrame, key: str) -> DataFrame:
    """key, at, near, kind, hash, ahead, words: the fingerprints of texts; `near` tells them apart by the words around them."""
    near = F.md5(F.concat_ws(" ", F.col("kind").cast("string"), F.col("ahead").cast("string"), F.array_join("words", " ")))
    return df.select(key, F.inline("found")).withColumn("near", near)


def _surroundings(places: DataFrame, side: str) -> DataFrame:
    """Each fingerprint once for all places where it has the same words around it."""
    return places.groupBy("kind", "hash", F.col("near").alias(f"{side}_near")).agg(F.any_value("ahead").alias(f"{side}_ahead"), F.any_value("words").alias(f"{side}_words"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """d_near, i_near, left, right: fingerprints of documents and items that reach a window when they are extended to both sides, and how far.

    Only distinct surroundings meet: a passage that many texts share, or a run of
    equal words, is compared once. docs, items: of _places.
    """
    pairs = _surroundings(docs, "d").join(_surroundings(items, "i").hint("merge"), ["kind", "hash"])
    left = _run(F.slice("d_words", 1, F.col("d_ahead")), F.slice("i_words", 1, F.col("i_ahead")), True)
    tail = lambda words, ahead: F.slice(words, F.col(ahead) + 1, F.size(words))
    right = _run(tail("d_words", "d_ahead"), tail("i_words", "i_ahead"), False)
    found = pairs.withColumn("left", left).withColumn("right", right)
    reached = F.when(F.col("kind") == 0, (F.col("right") >= gram) & (F.col("left") + F.col("right") >= window)).otherwise(F.col("right") >= F.col("kind"))
    return found.where(reached).select("d_near", "i_near", "left", "right")


def _hits(docs: DataFrame, items: DataFrame, window: int, gram: int, doc_id: str, text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """All rows of `docs` (doc_id, text_key, n_words), and k_id, k_text, n_hit, n_items, items_sha256 of those that have hits."""
    tests = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    marked = materialize(fingerprinted(tests, ["item_id"], "text", (), None, window, gram, True).withColumn("item_key", F.monotonically_increasing_id()), "items")
    hashes = marked.select(F.inline("found")).select("kind", "hash").distinct()
    short = tuple(r[0] for r in hashes.where("kind > 0").select("kind").distinct().orderBy("kind").collect())  # below `window`
    bits = bit_table(hashes)

    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("text_key", F.xxhash64("text"))
    read = materialize(fingerprinted(keyed, ["doc_id", "text_key"], "text", short, bits, window, gram, False), "documents")
    rows = read.where(F.size("found") > 0).dropDuplicates(["doc_id", "text_key"]).withColumn("doc_key", F.struct("doc_id", "text_key"))
    of_docs, of_items = _places(rows, "doc_key"), _places(marked, "item_key")
    met = materialize(hits(of_docs, of_items, window, gram), "hits")

    # All spans around a place share its gram, so the farthest ends of any item bound their union.
    reach = met.groupBy("d_near").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    spots = of_docs.select("doc_key", "at", F.col("near").alias("d_near"))
    reached = materialize(spots.join(reach.hint("merge"), "d_near").select("doc_key", "d_near", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end")), "spans")
    order = Window.partitionBy("doc_key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = reached.select("doc_key", "start", "end").withColumn("before", F.coalesce(before, F.lit(0)))
    n_hit = merged.groupBy("doc_key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).cast("long").alias("n_hit"))

    # Ids join after the comparison: the items of a surrounding, then those of a document.
    owners = met.select("d_near", "i_near").join(of_items.select("item_key", F.col("near").alias("i_near")).distinct().hint("merge"), "i_near")
    owners = materialize(owners.select("d_near", "item_key").distinct(), "owners")
    named = reached.select("doc_key", "d_near").distinct().join(owners.hint("merge"), "d_near").select("doc_key", "item_key").distinct()
    named = named.join(marked.select("item_key", F.col("item_id").cast("string").alias("id")), "item_key")
    n_items = named.groupBy("doc_key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    found = materialize(n_hit.join(n_items.hint("merge"), "doc_key").select(F.col("doc_key.doc_id").alias("__k_id"), F.col("doc_key.text_key").alias("__k_text"), "n_hit", "n_items", F.sha2("ids", 256).alias("items_sha256")), "hits")

    return read.select("doc_id", "text_key", "n_words"), found


def _same_document():
    return F.col("doc_id").eqNullSafe(F.col("__k_id")) & (F.col("text_key") == F.col("__k_text"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of `docs`."""
    read, found = _hits(docs, items, window, gram, doc_id, text, item_id, item_text)
    out = read.join(found, _same_document(), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` without any hit, with their columns."""
    _, found = _hits(docs, items, window, gram, doc_id, text, item_id, item_text)
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__k_id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__k_text"))
    return docs.join(found.select("__k_id", "__k_text"), same, "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark's items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
