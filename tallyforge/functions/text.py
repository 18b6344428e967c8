"""Column functions on free text: normalization, stems, variants and similarity."""

from __future__ import annotations

import string
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Accented letters and what they become.
ACCENTED = "áàäâãéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(col: str | Column, mode: str = "map") -> Column:
    """Lower case, accents off, other characters to spaces, spaces collapsed; null is empty.

    map: the fixed letters lose their accents. strip: every composed character is taken apart (NFKD) and loses its marks.
    """
    c = F.coalesce(_col(col), F.lit(""))
    c = F.lower(F.translate(c, ACCENTED, PLAIN) if mode == "map" else without_marks(c))
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks, on Arrow batches; Spark has no decomposition of its own."""
    import unicodedata

    return texts.map(lambda t: t if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def stem(token: str | Column) -> Column:
    """A simple plural stem: up to 3 characters as they are; -es off above 4; else -s off."""
    t = _col(token)
    n = F.length(t)
    return F.when(n <= 3, t).when(t.endswith("es") & (n > 4), F.left(t, n - 2)).when(t.endswith("s"), F.left(t, n - 1)).otherwise(t)


def variants(text: str | Column) -> Column:
    """Singular and plural spellings in the order they are tried: -es off (above 4), -s off (above 3), -s added."""
    t = _col(text)
    n = F.length(t)
    none = F.lit(None).cast("string")
    return F.array_compact(F.array(F.when(t.endswith("es") & (n > 4), F.left(t, n - 2)).otherwise(none), F.when(t.endswith("s") & (n > 3), F.left(t, n - 1)).otherwise(none), F.concat(t, F.lit("s"))))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T over longest matching blocks, on Arrow batches. Only for pairs that candidates() lets through."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


# Characters told apart in letter_bits; all others count together.
ALPHABET = string.ascii_letters + string.digits + " "
# Bits of each character, so the occurrences of it that are told apart.
OCCURRENCES = 8


_GROUPS = [ALPHABET[i : i + 8] for i in range(0, len(ALPHABET), 8)]


def letter_bits(text: str) -> list[Column]:
    """Of a column of texts: eight longs with a bit for each of the first OCCURRENCES occurrences of each character of ALPHABET, and the number of other characters.

    Two texts differ in at least as many characters as these bits differ.
    """
    bits = "shiftleft(shiftleft(1L, least(length({0}) - length(replace({0}, '{1}', '')), {2})) - 1L, {3})"
    words = [" | ".join(bits.format(f"`{text}`", x, OCCURRENCES, OCCURRENCES * i) for i, x in enumerate(group)) for group in _GROUPS]
    return [*map(F.expr, words), F.length(F.translate(text, ALPHABET, "")).cast("long")]


def fewest_changes(a: list[Column], b: list[Column]) -> Column:
    """The least number of characters, of both texts together, that no matching block can take up, from their letter_bits."""
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[:-1], b[:-1], strict=True)]) + F.abs(a[-1] - b[-1])


def candidates(texts: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """text, name of the distinct texts and names whose lengths and characters let `ratio` reach the cutoff.

    With M matched characters of T, the ratio is 2 M / T, so T - 2 M of them at most may be left over. A name meets the
    texts of fitting lengths, and the join itself drops a pair whose characters leave more: eight exclusive ors on longs,
    within generated code. Only what passes is a row.
    """
    farthest = (2.0 - cutoff) / cutoff
    number = len(_GROUPS) + 1
    marked = lambda df, c, tag: df.where(F.col(c) != "").select(c).distinct().select(c, F.length(c).alias(f"__{tag}len"), *[x.alias(f"__{tag}{i}") for i, x in enumerate(letter_bits(c))])
    t, n = marked(texts, "text", "t"), marked(names, "name", "n")
    reach = F.sequence(F.ceil(F.col("__nlen") / farthest - 1e-9).cast("int"), F.floor(F.col("__nlen") * farthest + 1e-9).cast("int"))
    n = n.withColumn("__met", F.explode(reach))
    left = fewest_changes(*[[F.col(f"__{tag}{i}") for i in range(number)] for tag in "tn"])
    near = left <= (1.0 - cutoff) * (F.col("__tlen") + F.col("__nlen")) + 1e-9
    return t.join(n.hint("merge"), (F.col("__tlen") == F.col("__met")) & near).select("text", "name")


def alike(texts: DataFrame, names: DataFrame, cutoff: float, names_first: bool = False) -> DataFrame:
    """text, name, sim of the distinct texts and names (columns text and name) whose similarity reaches the cutoff; none is lost.

    Python compares the candidates. Empty texts are similar to nothing.
    names_first: which of the two is the first argument of `ratio`, which decides between equal blocks.
    """
    met = candidates(texts, names, cutoff)
    return met.withColumn("sim", ratio("name", "text") if names_first else ratio("text", "name")).where(F.col("sim") >= cutoff)


def edit_ratio(a: str | Column, b: str | Column) -> Column:
    """1 - edit distance / longer length, without Python."""
    x, y = _col(a), _col(b)
    top = F.greatest(F.length(x), F.length(y))
    return F.when(top == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / top.cast("double"))
