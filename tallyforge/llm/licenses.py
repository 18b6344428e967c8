"""License scans: an Aho-Corasick automaton over words, and licence expressions by the shunting-yard algorithm.

Method: a text is reduced to its words (A-Z lower-cased, separated by one space)
and one pass of an Aho-Corasick automaton finds every notice phrase and every
identifier tag, at word boundaries. Behind each tag, the expression of the original
text is read with a shunting-yard parser: `or`, `and` and `with`, in that order of
rising strength, and parentheses. It ends with its line, and before the first thing
that can't continue it. Time grows with the text, however many places it has.

Each label has a permissiveness from 0 to 1. `or` gives the higher of its sides,
`and` the lower, `with` an exception raises its licence half the way to 1. The
score of a text is the lowest of its notices and expressions; a text without any
scores 0. An identifier that no table knows is a label by itself.

A notice inside a longer notice counts as part of it, unless it is a base phrase.

Defined cases: a null text is empty; overlapping places count each; a broken
expression yields its labels and their lowest score; repeated rows are scanned
each; an empty table gives an empty result; other columns of the table do no harm,
those named as a result give way to it. No shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table
from .words import PLAIN

# The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further notice phrases, in words: the default of the parameter `notices`.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache-2",
    "apache 2 0": "apache-2",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl-2",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "isc license": "isc",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# Identifiers whose label isn't the identifier itself: whole ones, then families of any version.
IDENTIFIERS = {"gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "unlicense": "public-domain", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3", "bsd-4-clause": "bsd-4"}
FAMILIES = {
    "apache": "apache-2", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl-2", "epl": "epl", "bsl": "bsl-1", "cc0": "cc0",
    "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by-nc": "cc-by-nc", "cc-by-nc-sa": "cc-by-nc", "cc-by-nc-nd": "cc-by-nc",
}
PERMISSIVENESS = {
    "mit": 1.0, "apache-2": 1.0, "bsd-2": 1.0, "bsd-3": 1.0, "bsd-4": 0.9, "zlib": 1.0, "isc": 1.0, "0bsd": 1.0, "bsl-1": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9,
    "mpl-2": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.4, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0,
}
UNKNOWN = 0.3
_STRENGTH = {"or": 1, "and": 2, "with": 3}
_TAGGED = re.compile(r"spdx-license-identifier\s*:", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_NEXT = re.compile(r"[ \t]*([()]|[A-Za-z0-9.+-]+)")
_VERSION = re.compile(r"-[0-9]+(?:\.[0-9]+)*$")


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operators wait on a stack until a weaker one, a bracket or the end. Raises ValueError if brackets or operands are out of order."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in tokens:
        low = token.lower()
        if low in _STRENGTH:
            if operand_next:
                raise ValueError("an operator without a left side")
            while stack and stack[-1] != "(" and _STRENGTH[stack[-1]] >= _STRENGTH[low]:
                out.append(stack.pop())
            stack.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next:
                raise ValueError("a bracket after an operand")
            stack.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("a bracket after an operator")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("a bracket never opened")
            stack.pop()
        else:
            if not operand_next:
                raise ValueError("two operands in a row")
            out.append(token)
            operand_next = False
    if operand_next or "(" in stack:
        raise ValueError("an unfinished expression")
    return out + stack[::-1]


def label_of(identifier: str) -> str:
    """The label of a licence identifier: `-only`, `-or-later` and `+` say nothing about it."""
    low = identifier.lower()
    plain = low.removesuffix("+").removesuffix("-only").removesuffix("-or-later")
    return IDENTIFIERS.get(plain) or FAMILIES.get(_VERSION.sub("", plain)) or plain


def expression_at(text: str, at: int) -> list[str]:
    """The tokens of the licence expression that starts at `at`: up to the end of its line, or to what can't continue it."""
    kept: list[str] = []
    operand_next = True
    while m := _NEXT.match(text, at):
        token, at = m[1], m.end()
        ends = token[-1] == "."
        token = token.rstrip(".")
        if not token or token.lower() == "spdx-license-identifier":
            break
        operator = token.lower() in _STRENGTH
        if not operand_next and token != ")" and not operator:
            break
        kept.append(token)
        operand_next = operator or token == "("
        if ends:
            break
    return kept


def evaluate(tokens: list[str], permissiveness: Mapping[str, float]) -> tuple[set[str], float]:
    """The labels of a licence expression and its permissiveness."""
    names = [t for t, before in zip(tokens, ["", *tokens], strict=False) if t not in "()" and t.lower() not in _STRENGTH and before.lower() != "with"]
    labels = {label_of(t) for t in names}
    try:
        stack: list[float] = []
        for t in to_postfix(tokens):
            if t in _STRENGTH:
                right, left = stack.pop(), stack.pop()
                stack.append(max(left, right) if t == "or" else min(left, right) if t == "and" else left + (1 - left) / 2)
            else:
                stack.append(permissiveness.get(label_of(t), UNKNOWN))
        return labels, stack[0]
    except ValueError:
        return labels, min((permissiveness.get(x, UNKNOWN) for x in labels), default=UNKNOWN)


@lru_cache(maxsize=8)
def automaton(notices: tuple[tuple[str, str], ...] = tuple(NOTICES.items())):
    """Every phrase between spaces, with its base label and label; built once in each Python worker."""
    import ahocorasick

    out, labels = ahocorasick.Automaton(), dict(notices)
    for phrase in {*BASE_PHRASES, *labels, TAG}:
        out.add_word(f" {phrase} ", (phrase, BASE_PHRASES.get(phrase), BASE_PHRASES.get(phrase) or labels.get(phrase)))
    out.make_automaton()
    return out


def widest(found: list[tuple[int, int, str | None, str]]) -> Iterator[tuple[int, int, str | None, str]]:
    """The places that lie in no longer place, and the base ones. Sorted by start and falling end, a place's container comes before it and reaches its end."""
    reach = -1
    for a, b, base, label in sorted(found, key=lambda x: (x[0], -x[1])):
        if base or b > reach:
            yield a, b, base, label
        reach = max(reach, b)


def scan(data: bytes, notices: tuple[tuple[str, str], ...] = tuple(NOTICES.items()), permissiveness: Mapping[str, float] = PERMISSIVENESS) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of a text."""
    words = data.translate(PLAIN).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    found, starts, tagged = [], [], False
    for end, (phrase, base, label) in automaton(notices).iter(line):
        # Where each word starts is worked out at the first place only.
        starts = starts or [0, *accumulate(len(w) + 1 for w in line[1:-1].split(" "))]
        first = bisect_left(starts, end - len(phrase) - 1)
        if label:
            found.append((first, first + phrase.count(" "), base, label))
        tagged |= phrase == TAG
    places = [first for first, _, base, _ in found if base]
    base_labels = {base for _, _, base, _ in found if base}
    # A notice inside a longer one is part of it: "cc by" of "cc by nc" grants nothing by itself.
    labels = {label for *_, label in widest(found)}
    scores = [permissiveness.get(x, UNKNOWN) for x in labels]
    if tagged:
        text = data.decode("utf-8", "replace")
        for m in _TAGGED.finditer(text):
            if tokens := expression_at(text, m.end()):
                more, score = evaluate(tokens, permissiveness)
                labels |= more
                scores.append(score)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), float(min(scores, default=0.0))


COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def with_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None, notices: Mapping[str, str] = NOTICES, permissiveness: Mapping[str, float] = PERMISSIVENESS) -> DataFrame:
    """Adds the columns of COLUMNS to each row. notices: further phrases (lower-case words) and their labels; permissiveness: of labels."""
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    phrases, grades = tuple(notices.items()), dict(permissiveness)

    def columns(texts: list[bytes]) -> dict:
        rows = [scan(x, phrases, grades) for x in texts]
        return {name: [r[i] for r in rows] for i, name in enumerate(names)}

    return map_texts(docs, columns, COLUMNS, text, keep)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and expressions of every document."""
    return with_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
