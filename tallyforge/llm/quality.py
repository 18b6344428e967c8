"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

Method: the words of a text are hashed once; rolling hashes give every n-gram of
each length in numpy, each length from the one before. The characters that lie
inside n-grams met before in the same text are counted once each and divided by all
characters of words; likewise the characters of lines that repeat. A text is rejected
when a share exceeds its threshold, and also by the base rules on length and repeated
3-word windows.

Words are runs of characters other than ASCII white space. Works row by row in
Arrow batches, without a shuffle; a long text costs memory for its own words only.

Defined cases: a null or empty text has no words and fails the base rule; texts
shorter than an n-gram length have no n-gram of it; repeated rows are judged
each; an empty table gives an empty result; other columns do no harm, those named as
a measure give way to it in with_quality and stay in passing.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table
from .words import WHITESPACE, WordHashes, longer, mix, word_hashes

SYMBOLS = b"#*$%&|<>"
# Largest share of characters inside repeated n-grams, by n. Published thresholds of repetition filters for web text.
GRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
# Largest share of characters in repeated lines.
LINE_SHARE = 0.30
COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "line_share double, gram_share double, base_failed boolean, kept boolean"
)


def _repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True where a hash occurs two times or more, the first included; and where it occurred before."""
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(hashes) + 1, bool)
    ordered = hashes[order]
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    twice[order], later[order] = same[1:] | same[:-1], same[:-1]
    return twice, later


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """True for words inside an n-gram that starts where `starts` is true."""
    steps = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measures(data: bytes, memo: WordHashes, gram_shares: Mapping[int, float], line_limit: float) -> tuple:
    words = data.split()
    n = len(words)
    plain = data.translate(None, WHITESPACE)
    word_chars = len(plain) - np.count_nonzero((np.frombuffer(plain, np.uint8) & 0xC0) == 0x80) if plain else 0
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = dup_line_bytes = line_bytes = 0
    for line in data.split(b"\n"):
        size = len(line.translate(None, WHITESPACE))
        if not size:
            continue
        line_bytes += size
        if line in seen:
            dup_lines += 1
            dup_line_bytes += size
        else:
            seen.add(line)
    line_share = dup_line_bytes / line_bytes if line_bytes else 0.0
    rolled = hashes = word_hashes(words, memo)
    sizes = np.fromiter(map(len, words), np.int64, n)
    whole = max(1, int(sizes.sum()))
    over, gram_share, repeat_words = False, 0.0, 0
    for k in range(1, max([3, *gram_shares]) + 1):
        rolled = longer(rolled, hashes, k) if k > 1 else hashes
        if k != 3 and k not in gram_shares:
            continue
        twice, later = _repeats(mix(rolled))
        if k == 3:
            repeat_words = int(_covered(twice, 3, n).sum())
        if k in gram_shares:
            share = float(sizes[_covered(later, k, n)].sum()) / whole
            gram_share = max(gram_share, share)
            over |= share > gram_shares[k]
        if k >= 3 and not later.any():
            break  # no repeated k-gram, so no longer one either
    failed = n < 50 or 100 * repeat_words > 50 * n
    return n, int(word_chars), symbols, dup_lines, repeat_words, line_share, gram_share, failed, not (failed or over or line_share > line_limit)


def with_quality(docs: DataFrame, text: str = "text", keep: list[str] | None = None, gram_shares: Mapping[int, float] = GRAM_SHARES, line_share: float = LINE_SHARE) -> DataFrame:
    """Adds the measures of COLUMNS to each row; `kept` is the verdict. gram_shares: n-gram lengths, ascending, and their limits."""
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    limits = dict(sorted(gram_shares.items()))

    def columns(texts: list[bytes]) -> dict:
        memo = _memo()
        rows = [measures(x, memo, limits, line_share) for x in texts]
        return {name: [r[i] for r in rows] for i, name in enumerate(names)}

    return map_texts(docs, columns, COLUMNS, text, keep)


def passing(docs: DataFrame, text: str = "text", gram_shares: Mapping[int, float] = GRAM_SHARES, line_share: float = LINE_SHARE) -> DataFrame:
    """The rows of `docs` that the rules keep, with their own columns, whatever their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{text}`").alias("__whole"))
    return with_quality(whole, "__whole", ["__doc"], gram_shares, line_share).where("kept").select("__doc.*")


_MEMO: list[WordHashes] = []


def _memo() -> WordHashes:
    """One memo of word hashes in each Python worker."""
    if not _MEMO:
        _MEMO.append(WordHashes())
    return _MEMO[0]


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality measures and verdict of every document."""
    return with_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])
