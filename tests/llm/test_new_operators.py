"""Importance resampling, byte-level BPE and the divergence audit, against plain rewritings of their contracts."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import pytest

from tallyforge.llm import bpe, divergence, importance
from tallyforge.llm.token_counts import VOCABULARY, encoder

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i * 7919 % 4001}" for i in range(25_000))
ODD = [None, "", " \t\n", "-", "Aa", "Éa é,É", "a" * 3, "x\x00y\x7fz", "one two", "the THE the The the", LONG]


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def features(text):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def drawn(rows, target, percent=5, least=20):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)))
    for text in target:
        t.update(map(bucket, features(text)))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0)))) for b in range(10_000)]
    out = []
    for doc_id, text in rows:
        found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def by_repr(rows):
    return sorted(map(tuple, rows), key=repr)


def test_resampling_against_brute_force(spark, docs, rows, no_docs):
    plain = [(r[0], r[1]) for r in rows]
    target = [rows[3][1], "Mixed, TEXT of the target", None, "", rows[8][1]]
    aims = spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int")
    for percent in (5, 40, 100):
        got = importance.resampled(docs, aims, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert by_repr(got) == by_repr(drawn(plain, target, percent))
    ranks = [r.rank for r in got if r.rank is not None]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) > 100
    assert importance.resampled(no_docs, aims).count() == 0
    assert by_repr(importance.resampled(docs, aims.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()) == by_repr(drawn(plain, []))


def test_resampling_of_odd_texts_and_repeated_rows(spark):
    rows = [(i % 9, x) for i, x in enumerate(ODD * 3)] + [(7, LONG)] * 40 + [(i, " ".join(f"t{i % 3}{j}" for j in range(25))) for i in range(60)]
    docs = spark.createDataFrame([(x, i, 5, 6) for i, x in rows], "text string, doc_id long, rank int, buckets int").repartition(5)
    target = [f"t1{j} t1{j + 1}" for j in range(20)]
    got = importance.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent=30).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert by_repr(got) == by_repr(drawn(rows, target, 30))


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_spans_are_counted_in_pieces(longest):
    for text in [*ODD, "a b", "a b c d e f"]:
        w = plain_words(text)
        want = Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
        assert Counter(x for part in importance.checksums((text or "").encode(), longest) for x in part) == want


def test_encoding_equals_the_library(spark, docs, rows):
    library = encoder(VOCABULARY).encode_ordinary
    texts = [(r[0], r[1]) for r in rows] + [(1000 + i, x) for i, x in enumerate([*ODD, "<|endoftext|> it's  I'LL\n\n x", "日本語のテキスト と 한국어 🙂🙂🙂‍👩", "=" * 5000, "ab" * 3000, "é́" * 700, " " * 999 + "x" + "\t" * 50])]
    got = bpe.with_decoded(bpe.with_ids(spark.createDataFrame([(*x, b"1") for x in texts], "doc_id long, text string, decoded binary").repartition(4))).collect()
    assert by_repr((r.doc_id, r.text, r.ids, bytes(r.decoded)) for r in got) == by_repr((i, x, library(x or ""), (x or "").encode()) for i, x in texts)
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [5, 6])], "doc_id int, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.with_decoded(nulls).orderBy("doc_id").collect()] == [b"", b"", bpe.decode([5, 6])]
    assert bpe.with_decoded(bpe.with_ids(docs.limit(0))).count() == 0


def test_remembered_pieces_are_forgotten_by_generations(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 7)
    library, pieces = encoder(VOCABULARY).encode_ordinary, bpe.Pieces(bpe.ranks_of(VOCABULARY))
    for i in range(3000):
        word = f"xq{i * i % 19}zzv"
        assert list(pieces[word]) == library(word) if len(bpe.pieces_of(VOCABULARY).findall(word)) == 1 else True
        assert len(pieces) <= 7 and len(pieces.older) <= 7
    assert bpe.encode(" ".join(LONG.split()[:3000])).tolist() == library(" ".join(LONG.split()[:3000]))


def test_every_code_point_splits_as_in_the_library():
    library = encoder(VOCABULARY).encode_ordinary
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 4096):
        block = points[i : i + 4096]
        for text in ("".join(f"a{chr(c)}1" for c in block), "".join(f"  {chr(c)} {chr(c)}b" for c in block)):
            if bpe.encode(text).tolist() != library(text):
                assert [c for c in block if bpe.encode(f"a{chr(c)}1").tolist() != library(f"a{chr(c)}1") or bpe.encode(f"  {chr(c)} {chr(c)}b").tolist() != library(f"  {chr(c)} {chr(c)}b")] == []


def test_merges_follow_the_leftmost_least_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"aa": 301, b"abc": 302, b"aaaa": 303, b"cd": 299 + 5}
    rng = random.Random(3)

    def slow(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            least = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if least is None:
                return [ranks[p] for p in parts]
            i = least[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(400):
        piece = bytes(rng.choice(b"aaabcd") for _ in range(rng.randint(1, 40)))
        assert bpe.merged(piece, ranks) == slow(piece)


def audited(rows, least_docs=10, top=10):
    """lang, source, part, item, value, rank of (text, lang, source) rows, over all kept terms."""
    found, having, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        each = Counter(LETTERS.findall(text.translate(LOWER)))
        having[lang].update(each.keys())
        found[lang, source].update(each)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in having[lang].items() if n >= least_docs]
        of = {s: {t: found[lang, s][t] for t in kept} for s in sources}
        of[None] = {t: sum(of[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 1_000_000_000 * (c + 2) // (sum(n.values()) + 2 * len(kept)) for t, c in n.items()} for s, n in of.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            own = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if of[s][t] and p[s][t] > p[None][t])[:top]
            for part, ranked in (("pair", pairs), ("term", own)):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize("held", [500_000, 50])
def test_audit_against_all_terms(spark, docs, rows, no_docs, held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", held)
    plain = [(r[1], r[2], r[3]) for r in rows]
    for least_docs in (10, 2, 10_000):
        got = divergence.audit(docs, least_docs=least_docs).collect()
        assert by_repr(got) == by_repr(audited(plain, least_docs))
    assert divergence.audit(no_docs).count() == 0


def test_audit_of_odd_texts_and_many_sources(spark):
    rng = random.Random(11)
    rows = [(x, lang, source) for x in ODD for lang in ("en", None, "de") for source in ("a", None, "É", "zz")]
    rows += [(" ".join(rng.choice(["Über", "x", "the", "of", "naïve", "y2k", f"w{i % 40}", "tie", "eit"]) for _ in range(rng.randint(0, 30))), "en" if i % 3 else "fr", f"s{i * i % 31}") for i in range(900)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, n int").repartition(6)
    assert by_repr(divergence.audit(docs).collect()) == by_repr(audited(rows))
    assert by_repr(divergence.audit(docs, least_docs=1, top=3).collect()) == by_repr(audited(rows, 1, 3))


def test_shares_are_exact_beyond_a_long(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(123_456_789_012_345, 987_654_321_098_765, 7_777_777)], "n long, total long, kept long")
    got = row.select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).first().p
    assert got == 1 + 1_000_000_000 * (123_456_789_012_345 + 2) // (987_654_321_098_765 + 2 * 7_777_777)
