"""Secret scans: base patterns, and sliding-window Shannon entropy over candidate strings.

Method: runs of at least 20 characters of a key alphabet are candidates. Each is
put in a character class by what it holds (hexadecimal, lower case with digits,
mixed case with digits, letters whose case keeps changing); a window slides over it, its counts are updated by one
character out and one in, and so is the sum c*log2(c) from which the entropy
follows. Windows over the class's threshold are joined to spans. Candidates on
the allow list (plain words, paths, identifiers in UUID form, numbers, few
distinct characters) are suppressed.

Base kinds are found by pattern and always stay; an entropy span inside a base
span adds nothing and is left out. Offsets are code points of the whole text.

Defined cases: a null text is an empty one; repeated rows are scanned each; an
empty table gives an empty result; other columns do no harm, those named as a result
give way to it. Time grows with the text, however many spans it has. No shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Candidates of the entropy method are runs of these.
KEY_CHARACTERS = "A-Za-z0-9+/_=-"
_KEY_BYTES = np.array([bool(re.match(f"[{KEY_CHARACTERS}]", chr(b))) and b < 128 for b in range(256)], np.int8)
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")

WINDOW = 20
# Least entropy of a window in bits a character, by class.
THRESHOLDS = {"hex": 3.0, "lower": 3.6, "mixed": 3.7, "letters": 3.9}
# Of neighbouring letters, one in so many changes case in random letters and fewer in words joined by capitals.
CASE_CHANGE = 3
ALLOWED = (
    re.compile(r"[A-Za-z]+(?:[_/=+-][A-Za-z]+)*[0-9]{0,4}"),  # words, paths and dashed names, with a short number
    re.compile(r"[0-9+/_=-]+"),  # numbers, rules, dates
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),  # UUIDs
    # Slugs: words, then short parts. Possessive, so that a long slug is read once.
    re.compile(r"[a-z]++(?:[-_/][a-z]++(?![0-9]))*+(?:[-_/][a-z0-9]{1,6}(?![a-z0-9]))*+"),
)
_CLOG = [0.0, *(c * math.log2(c) for c in range(1, 4097))]


def char_class(s: str) -> str | None:
    """The class of a candidate; None if it has no letter, or no digit and the case of words: no threshold separates these from words and numbers."""
    if not re.search(r"[A-Za-z]", s):
        return None
    if not re.search(r"[0-9]", s):
        changes = len(re.findall(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])", s))
        return "letters" if CASE_CHANGE * changes >= len(s) - 1 else None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return "hex"
    return "mixed" if re.search(r"[a-z]", s) and re.search(r"[A-Z]", s) else "lower"


def entropy_spans(s: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined spans of the windows of `s` whose entropy reaches the threshold, by incremental counts."""
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    least = window * (math.log2(window) - threshold)  # H >= threshold when sum c*log2(c) <= this
    for i, new in enumerate(s):
        c = counts.get(new, 0)
        total += _CLOG[c + 1] - _CLOG[c]
        counts[new] = c + 1
        if i >= window:
            old = s[i - window]
            c = counts[old]
            total -= _CLOG[c] - _CLOG[c - 1]
            counts[old] = c - 1
        if i >= window - 1 and total <= least + 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def long_runs(data: bytes, least: int = 20) -> list[tuple[int, int]]:
    """Byte ranges of the maximal runs of at least `least` key characters, by one vectorised pass."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _KEY_BYTES[np.frombuffer(data, np.uint8)]
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def scan(data: bytes, window: int = WINDOW) -> tuple[list, list]:
    """(start, kind index, end) of the base spans, and of all spans with those of the entropy method, by start, then kind."""
    base: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []
    low = data.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data.decode("utf-8", "replace")) if len(m[2]) >= 6]
    # Every access key, hexadecimal string and candidate lies inside one long run of key characters.
    byte_at = code_at = 0
    for a, b in long_runs(data):
        code_at += len(data[byte_at:a].decode("utf-8", "replace"))
        byte_at = a
        run = data[a:b].decode()
        base += [(code_at + m.start(), 1, code_at + m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= 20]
        base += [(code_at + m.start(), 2, code_at + m.end()) for m in HEX.finditer(run)]
        kind = char_class(run)
        if kind == "letters" or kind is not None and not any(x.fullmatch(run) for x in ALLOWED):
            more += [(code_at + x, 3, code_at + y) for x, y in entropy_spans(run, THRESHOLDS[kind], window)]
    base.sort()
    return base, sorted([*base, *outside(more, base)])


def outside(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """The spans of `more` that lie in none of `base`; both by start, so one sweep decides: of the base spans that start no later, the farthest end tells."""
    at = reach = 0
    for x, kind, y in more:
        while at < len(base) and base[at][0] <= x:
            reach = max(reach, base[at][2])
            at += 1
        if y > reach:
            yield x, kind, y


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def with_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_entropy, base_spans and spans (kind:start:end, comma-joined) to each row."""

    def columns(texts: list[bytes]) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "n_entropy", "base_spans", "spans")}
        for data in texts:
            base, every = scan(data, window)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(s[1] == k for s in every))
            out["base_spans"].append(joined(base))
            out["spans"].append(joined(every))
        return out

    return map_texts(docs, columns, "n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_spans string, spans string", text, keep)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the digest of the base spans."""
    found = with_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_entropy")
