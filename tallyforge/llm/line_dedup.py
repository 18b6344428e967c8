"""Line dedup by content-defined chunks of lines.

Method: each line is hashed; a rolling hash over two neighbouring lines decides
whether a chunk ends there, so boundaries depend on content alone and survive
insertions before them. Several independent boundary rules are used, because a
passage's first and last lines share a chunk with what surrounds them under any
one rule. Besides, the shortest run of 40 words from a line on is a chunk, for the line
with the least hash of every 16 words; a longer line is always one. Which lines these are depends only on
the lines inside, so a repeated passage of 56 words or more has such a chunk, whatever stands around
it; and with lines of more than 8 words, of which every one begins a run, 40 words are enough. Chunks of several
lines, or of one long line, that occur at more than one place of the corpus are
removed from all places but the first (by doc_id, then position), after their bytes
were compared with those of the first place. From there the comparison goes on line by
line to both sides, as far as a run may have missed of a passage, so that it goes whole.

One pass over the texts writes a row for each chunk: a 128-bit hash and its place. Short lines
begin few runs, so these rows are fewer bytes than the texts, whatever the length of
lines. They are counted by hash and joined with the hashes
that repeat, at any number of repeats and without a table of fixed size; the driver
gets nothing. Chunks of a text that lie alike in the same first text are joined to
ranges, so overlapping chunks are compared once. The first texts give the lines of
these ranges, in pieces of a few lines; each piece meets the text that is to lose it,
and goes only if it is equal there. So equal hashes alone remove nothing. Texts move twice: to be read as first texts, and
to be cut.

Defined cases: a null text stays null and an empty one empty; blank lines belong
to chunks but a chunk without a word is never removed; rows equal in doc_id and
text are one place, and keep the same lines; an empty table gives an empty
result; removing all lines leaves an empty text; columns named as a count give way.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import partial, reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, small_batches, table
from .words import mix

RULES = 3
MIN_LINES, MIN_WORDS = 2, 40
# Of the lines of so many words, one begins a run.
WINDOW_WORDS = 16
# Lines that are compared at a time. Bounds how many ranges of a first text differ, however many texts repeat parts of it.
PIECE_LINES = 16
_CHUNK = "struct<first: int, last: int, digest: binary>"


def _runs(hashes: np.ndarray, words: np.ndarray, words_to: np.ndarray, min_words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest runs of min_words words from the chosen lines on: of the lines from each one on that have `window` words together, that of the least hash, the last of equals."""
    at = np.flatnonzero(words > 0)
    v, n = mix(hashes[at]), len(at)
    many = np.maximum(1, np.searchsorted(words_to[at + 1], words_to[at] + window, "right") - np.arange(n))
    best, chosen = v.copy(), np.arange(n)
    for j in range(1, int(many.max(initial=1))):
        i = np.flatnonzero(many > j)
        take = i[v[i + j] <= best[i]]
        best[take], chosen[take] = v[take + j], take + j
    at = at[np.unique(chosen)]
    last = np.searchsorted(words_to, words_to[at] + min_words)
    whole = last < len(words_to)
    return at[whole], last[whole]


def chunks(data: bytes, rules: int = RULES, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, window: int = WINDOW_WORDS) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The lines of a text, and first and last line (exclusive) of its chunks that are long enough, each once."""
    import xxhash

    lines = data.split(b"\n")
    h = np.fromiter((xxhash.xxh64_intdigest(x, 11) for x in lines), np.uint64, len(lines))
    rolled = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.r_[np.uint64(0), h[:-1]])
    words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    words_to = np.r_[0, np.cumsum(words)]
    firsts, lasts = [], []
    for rule in range(rules):
        ends = np.flatnonzero((rolled >> np.uint64(rule)) & np.uint64(1) == 0) + 1
        cuts = np.r_[0, ends] if len(ends) and ends[-1] == len(lines) else np.r_[0, ends, len(lines)]
        firsts.append(cuts[:-1])
        lasts.append(cuts[1:])
    a, b = np.concatenate(firsts), np.concatenate(lasts)
    n = words_to[b] - words_to[a]
    long = (n > 0) & ((b - a >= min_lines) & (n >= min_words // 4) | (n >= min_words))
    more_a, more_b = _runs(h, words, words_to, min_words, window)
    found = np.unique(np.r_[a[long], more_a] * (len(lines) + 1) + np.r_[b[long], more_b])
    return lines, list(zip((found // (len(lines) + 1)).tolist(), (found % (len(lines) + 1)).tolist(), strict=True))


def with_chunks(docs: DataFrame, keep: list[str], text: str, **shape) -> DataFrame:
    """Adds found, the chunks of each text with a hash of their bytes."""
    import xxhash

    def columns(texts: list[bytes]) -> dict:
        rows = []
        for data in texts:
            lines, parts = chunks(data, **shape)
            starts = [0, *accumulate(len(x) + 1 for x in lines)]
            rows.append([{"first": a, "last": b, "digest": xxhash.xxh3_128_digest(data[starts[a] : starts[b] - 1])} for a, b in parts])
        return {"found": rows}

    return map_texts(docs, columns, f"found array<{_CHUNK}>", text, keep)


def repeats(docs: DataFrame, **shape) -> DataFrame:
    """doc_id, text_key, first, last, keep_id, keep_key, keep_first: each repeated chunk, and where it stands first. docs: doc_id, text, text_key."""
    places = materialize(with_chunks(docs, ["doc_id", "text_key"], "text", **shape).select("doc_id", "text_key", F.inline("found")), "places")
    place = F.struct("doc_id", "text_key", "first")
    firsts = materialize(places.groupBy("digest").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    hit = places.join(firsts.hint("merge"), "digest").where(~place.eqNullSafe(F.col("keep")))
    kept = [F.col(f"keep.{x}").alias(y) for x, y in (("doc_id", "keep_id"), ("text_key", "keep_key"), ("first", "keep_first"))]
    return hit.select("doc_id", "text_key", "first", "last", *kept).distinct()


def pieces(hit: DataFrame, piece_lines: int = PIECE_LINES) -> DataFrame:
    """doc_id, text_key, keep_id, keep_key, a, b, begins, ends, ranges: which lines of a text (first, last) repeat lines a to b of a first text; n: how many chunks begin with a piece.
    begins, ends: whether the joined chunks do with it.

    Chunks at the same distance from their first places are joined where they touch, then cut at every piece_lines lines of the first text.
    """
    alike = ["doc_id", "text_key", "keep_id", "keep_key", "shift"]
    order = Window.partitionBy(*alike).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = hit.withColumn("shift", F.col("first") - F.col("keep_first")).withColumn("apart", F.coalesce(reach < F.col("first"), F.lit(True)).cast("int"))
    joined = apart.withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy(*alike, "run").agg((F.min("first") - F.col("shift")).alias("from"), (F.max("last") - F.col("shift")).alias("to"), F.count(F.lit(1)).alias("n"))
    own = lambda c: F.floor(F.col(c) / piece_lines).cast("int")
    cut = joined.withColumn("piece", F.explode(F.sequence(own("from"), F.floor((F.col("to") - 1) / piece_lines).cast("int"))))
    cut = cut.withColumns({"a": F.greatest("from", F.col("piece") * piece_lines), "b": F.least("to", (F.col("piece") + 1) * piece_lines)})
    n = F.when(F.col("piece") == own("from"), F.col("n")).otherwise(0)
    there = F.struct((F.col("a") + F.col("shift")).alias("first"), (F.col("b") + F.col("shift")).alias("last"), n.cast("long").alias("n"))
    ends = ((F.col("a") == F.col("from")).alias("begins"), (F.col("b") == F.col("to")).alias("ends"))
    return cut.groupBy("doc_id", "text_key", "keep_id", "keep_key", "a", "b", *ends).agg(F.collect_list(there).alias("ranges"))


def _around(words_to: list[int], a: int, b: int, before: int, after: int) -> tuple[int, int]:
    """The lines from a to b with those before and after that have at most so many words together. words_to: words up to each line."""
    return bisect_left(words_to, words_to[a] - before), bisect_right(words_to, words_to[b] + after) - 1


def _lines_of(batches, before: int, after: int):
    """Rows keep_id, keep_key, text, ranges (a, b, begins, ends); returns a row with the lines of each range, and of what lies around its ends: lead lines before a, and those behind b."""
    for batch in batches:
        for i, (text, ranges) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            lines = (text or "").split("\n")
            words_to = [0, *accumulate(len(x.encode().split()) for x in lines)]
            for at in range(0, len(ranges), 1024):
                part = ranges[at : at + 1024]
                of = [batch.column(k).take(pa.array([i] * len(part))) for k in (0, 1)]
                a, b, begins, ends = ([r[x] for r in part] for x in ("a", "b", "begins", "ends"))
                wide = [_around(words_to, x, y, before, after) for x, y in zip(a, b, strict=True)]
                first = [w[0] if begin else x for w, x, begin in zip(wide, a, begins, strict=True)]
                last = [w[1] if end else y for w, y, end in zip(wide, b, ends, strict=True)]
                kept = ["\n".join(lines[x:y]) for x, y in zip(first, last, strict=True)]
                lead = [x - y for x, y in zip(a, first, strict=True)]
                arrays = [*of, *(pa.array(x, pa.int32()) for x in (a, b)), *(pa.array(x, pa.bool_()) for x in (begins, ends)), pa.array(lead, pa.int32()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:2], "a", "b", "begins", "ends", "lead", "kept"])


def removals(docs: DataFrame, **shape) -> DataFrame:
    """doc_id, text_key, cut: the lines of first places (kept, the first `lead` of them before the range), and the ranges of each text that repeat them. docs: doc_id, text."""
    before, after = shape.get("window", WINDOW_WORDS), shape.get("min_words", MIN_WORDS)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    compared = materialize(pieces(repeats(keyed, **shape)), "pieces")
    asked = ["a", "b", "begins", "ends"]
    where = ["keep_id", "keep_key", *asked]
    wanted = compared.select(*where).distinct().groupBy("keep_id", "keep_key").agg(F.collect_list(F.struct(*asked)).alias("asked"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_key") == F.col("keep_key"))
    found = keyed.join(materialize(wanted, "wanted").hint("merge"), same).select("keep_id", "keep_key", "text", "asked")
    schema = compared.select("keep_id", "keep_key").schema.add("a", "integer").add("b", "integer").add("begins", "boolean").add("ends", "boolean").add("lead", "integer").add("kept", "string")
    # Rows equal in doc_id and text give the same lines.
    lines = found.mapInArrow(partial(_lines_of, before=before, after=after), schema)
    kept = materialize(lines.groupBy(*where).agg(F.any_value("lead").alias("lead"), F.any_value("kept").alias("kept")), "kept")
    kept = kept.withColumnsRenamed({"keep_id": "__id", "keep_key": "__key"})
    met = reduce(lambda x, y: x & y, [compared[c] == kept[c] for c in asked], F.col("keep_id").eqNullSafe(F.col("__id")) & (F.col("keep_key") == F.col("__key")))
    return compared.join(kept.hint("merge"), met).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kept", "lead", "ranges")).alias("cut"))


def _cut_lines(batches):
    """Rows whose last two columns are the text and its cuts; returns them with the text cut, where its lines equal those kept, and the counts added."""
    for batch in batches:
        texts, cuts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        out, n_lines, n_removed, n_chunks = [], [], [], []
        for text, cut in zip(texts, cuts, strict=True):
            lines = text.split("\n") if text is not None else []
            gone, found = np.zeros(len(lines), bool), 0
            for c in cut or ():
                kept, lead = c["kept"].split("\n"), c["lead"]
                for r in c["ranges"]:
                    first, last = r["first"], r["last"]
                    behind = lead + last - first
                    if lines[first:last] == kept[lead:behind]:
                        found += r["n"]
                        ahead = lead
                        while ahead and first and lines[first - 1] == kept[ahead - 1]:
                            first, ahead = first - 1, ahead - 1
                        while last < len(lines) and behind < len(kept) and lines[last] == kept[behind]:
                            last, behind = last + 1, behind + 1
                        gone[first:last] = True
            n_lines.append(len(lines))
            n_removed.append(int(gone.sum()))
            n_chunks.append(found)
            out.append(text if not cut else "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g))
        arrays = [pa.array(out, pa.string()), *(pa.array(x, pa.int64()) for x in (n_lines, n_chunks, n_removed))]
        names = [*batch.schema.names[:-2], "text", "n_lines", "n_cut_chunks", "n_cut_lines"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *arrays], names=names)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, **shape) -> DataFrame:
    """The rows of `docs` with repeated chunks removed from the text, and n_lines, n_cut_chunks, n_cut_lines added.

    keep: columns to return besides the text; default all. shape: rules, min_lines and min_words of chunks().
    """
    small_batches(docs.sparkSession)
    cut = materialize(removals(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), **shape), "cuts").toDF("__k_id", "__k_text", "__cut")
    names = [c for c in (docs.columns if keep is None else keep) if c not in (text, "n_lines", "n_cut_chunks", "n_cut_lines")]
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__k_id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__k_text"))
    # Most of the texts move here, whatever the size of the corpus; so the join is the same at every size.
    rows = docs.join(cut.hint("merge"), same, "left").select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("text"), "__cut")
    schema = rows.select(*[F.col(f"`{c}`") for c in names], "text").schema.add("n_lines", "long").add("n_cut_chunks", "long").add("n_cut_lines", "long")
    out = rows.mapInArrow(_cut_lines, schema)
    return out if text == "text" else out.withColumnRenamed("text", text)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks of lines that the corpus has elsewhere."""
    return without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
