"""Operators over whole tables, against brute force on a small table."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, line_dedup, mixing, sharding, simhash, warc

# ---- sharding


def test_shards_hold_equal_counts(docs, rows, no_docs):
    got = sharding.contract(sharding.shard_documents(docs)).collect()
    want = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    again = sharding.contract(sharding.shard_documents(docs.repartition(7, "lang"))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sharding.shard_documents(no_docs).count() == 0


def test_allot_is_the_ring_walk():
    loads, owners = [5, 0, 9, 2, 4], [0, 1, 0, 2, 1]
    out = sharding.allot(loads, owners, {0: 7, 1: 7, 2: 6})
    per_shard, per_arc = Counter(), defaultdict(list)
    for arc, first, shard, n in out:
        per_shard[shard] += n
        per_arc[arc].append((first, n))
    assert per_shard == {0: 7, 1: 7, 2: 6}
    for arc, n in enumerate(loads):
        at = 0
        for first, k in sorted(per_arc[arc]):
            assert first == at
            at += k
        assert at == n
    # With room for all, nobody leaves home.
    assert all(shard == owners[arc] for arc, _, shard, _ in sharding.allot(loads, owners, {0: 99, 1: 99, 2: 99}))


def test_overflow_goes_to_the_next_point_with_room():
    """Row by row: all first choices, then all second ones, and so on; a row takes the first point clockwise that has room when its turn comes."""
    import random

    rng = random.Random(11)
    for _ in range(20):
        owners = [rng.randrange(4) for _ in range(12)]
        loads = [rng.choice([0, 0, 1, 5, 30]) for _ in owners]
        total = sum(loads)
        room = {s: total // 4 + (s < total % 4) for s in range(4)}
        want, waiting = Counter(), {(a, i) for a, n in enumerate(loads) for i in range(n)}
        left = dict(room)
        for distance in range(len(owners)):
            for a, i in sorted(waiting):
                shard = owners[(a + distance) % len(owners)]
                if left[shard]:
                    left[shard] -= 1
                    want[a, shard] += 1
                    waiting.discard((a, i))
        got = Counter()
        if set(owners) == {0, 1, 2, 3}:
            for a, _, shard, n in sharding.allot(loads, owners, room):
                got[a, shard] += n
            assert got == want and not waiting


def test_rows_walk_the_ring(spark):
    """Shards of all rows, from the ring's points and the rows' hashes alone."""
    keys = list(range(600)) + [7] * 300
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    cell = dict(df.selectExpr("k", f"cast(pmod(xxhash64('key', k), {sharding.CELLS}) as int) AS c").distinct().collect())
    points = [(r.c, r.shard) for r in spark.range(5 * 8).selectExpr("cast(id % 5 as int) AS shard", "floor(id / 5) AS v").selectExpr("shard", f"cast(pmod(xxhash64('point', shard, v), {sharding.CELLS}) as int) AS c").collect()]
    at = {}
    for c, shard in points:
        at[c] = min(at.get(c, 99), shard)
    ordered = sorted(at)
    arc = lambda k: next((i for i, c in enumerate(ordered) if c >= cell[k]), 0)
    loads = Counter(arc(k) for k in keys)
    left = {s: len(keys) // 5 + (s < len(keys) % 5) for s in range(5)}
    want, waiting = Counter(), dict(loads)
    for distance in range(len(ordered)):
        for a in sorted(waiting):
            shard = at[ordered[(a + distance) % len(ordered)]]
            n = min(waiting[a], left[shard])
            want[a, shard] += n
            waiting[a] -= n
            left[shard] -= n
    got = Counter((arc(r.k), r.shard) for r in sharding.with_shard(df, "k", 5, 8).collect())
    assert got == +want


def test_one_key_with_a_third_of_the_rows(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 2 = 0, 'same', cast(id AS string)) AS text")
    counts = sharding.shard_documents(df, 7).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in counts) == [428] * 3 + [429] * 4


def test_slack_keeps_more_rows_at_home_and_growth_moves_few(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    away = {s: sharding.shard_documents(df, 16, slack=s).where("shard <> home_shard").count() for s in (0.0, 0.25)}
    assert away[0.25] < away[0.0] < 20000 * 0.15
    a, b = (sharding.shard_documents(df, n, slack=0.25).select("doc_id", "shard") for n in (16, 17))
    moved = a.join(b.withColumnRenamed("shard", "then"), "doc_id").where("shard <> then").count()
    assert moved < 20000 * 0.2


# ---- mixing


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        level = budget / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= over


def test_mix_meets_targets(docs, rows, no_docs):
    got = mixing.with_copies(docs.select("doc_id", "source", "text")).collect()
    words = [(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    assert sorted(((r.doc_id, r.source, r["size"]) for r in got), key=repr) == sorted(words, key=repr)
    sizes = Counter()
    for _, s, n in words:
        sizes[s] += n
    want = expected_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(want[s]) and mine[0].source_size == sizes[s]
        assert abs(sum(r.copies * r["size"] for r in mine) - want[s]) <= max(2, 0.02 * want[s])
    assert {r.copies for r in got} <= {0, 1, 2}
    again = mixing.with_copies(docs.select("doc_id", "source", "text").repartition(5, "source")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.with_copies(no_docs.select("doc_id", "source", "text")).count() == 0


def test_mixed_repeats_rows(docs):
    taken = {(r.doc_id, r.n) for r in mixing.with_copies(docs.where("doc_id is not null and doc_id not in (1, 7, 12)")).where("copies > 0").selectExpr("doc_id", "copies as n").collect()}
    out = mixing.mixed(docs.where("doc_id is not null and doc_id not in (1, 7, 12)"))
    assert out.columns == docs.columns
    assert sum(n for _, n in taken) == out.count()


def test_rates_solve_the_dual(spark):
    cells = spark.createDataFrame([("a", z, z % 3 + 1) for z in range(1, 60)], "skey string, size long, n long")
    total = sum(z * (z % 3 + 1) for z in range(1, 60))
    for share in (0.05, 0.7, 1.0, 1.6, 1.95):
        wanted = spark.createDataFrame([("a", total, share * total)], "skey string, source_size long, target double")
        r = mixing.tilts(cells, wanted).first()
        import math

        words = sum(n * z * 2 / (1 + math.exp(-r.lam * z / r["mean"])) for z, n in ((z, z % 3 + 1) for z in range(1, 60)))
        assert abs(words - share * total) <= max(0.5, 1e-4 * share * total)


def test_unsettled_tilts_raise(spark):
    cells = spark.createDataFrame([("a", z, 1) for z in range(1, 60)], "skey string, size long, n long")
    wanted = spark.createDataFrame([("a", 1770, 3100.0)], "skey string, source_size long, target double")
    with pytest.raises(RuntimeError):
        mixing.tilts(cells, wanted, steps=mixing.STEPS_A_WRITE, tolerance=1e-15)


def test_copies_follow_the_rates_and_meet_the_target(spark):
    """Cells round on their running sum, and no document that still fits is left over."""
    import math
    import random

    rng = random.Random(5)
    cells = {(k, z): rng.randint(1, 40) for k in "abc" for z in rng.sample(range(1, 900), 70)}
    totals = Counter()
    for (k, z), n in cells.items():
        totals[k] += z * n
    share = {"a": 0.2, "b": 1.3, "c": 2.0}
    rows = spark.createDataFrame([(k, z, n) for (k, z), n in cells.items()], "skey string, size long, n long")
    wanted = spark.createDataFrame([(k, totals[k], share[k] * totals[k]) for k in totals], "skey string, source_size long, target double")
    tilted = mixing.tilts(rows, wanted)
    lam = {r.skey: (r.lam, r["mean"], r.full) for r in tilted.collect()}
    got = {(r.skey, r["size"]): r.copies for r in mixing.cell_copies(rows, tilted).collect()}
    assert set(got) == set(cells) and lam["c"][2]
    for k in "abc":
        mine = sorted(((z, n) for (s, z), n in cells.items() if s == k), reverse=True)
        miss = round(share[k] * totals[k]) - sum(z * got[k, z] for z, _ in mine)
        room = lambda z, n: (2 * n - got[k, z]) if miss > 0 else got[k, z]  # noqa: B023, E731
        assert not [z for z, n in mine if z <= abs(miss) and room(z, n)]
        expected, off = 0.0, 0
        for z, n in mine:
            rate = 2.0 if lam[k][2] else 2 / (1 + math.exp(-lam[k][0] * z / lam[k][1]))
            expected += n * rate
            assert 0 <= got[k, z] <= 2 * n
            off += abs(got[k, z] - n * rate) > 2
        assert off <= 6  # cells changed to meet the target


def test_equal_rows_share_their_copies(spark):
    rows = [(7, "a b c", "s")] * 900 + [(i, "w " * (i % 50 + 1), "s" if i % 2 else "t") for i in range(400)] + [(8, None, "t")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.with_copies(df).collect()
    assert sorted(((r.doc_id, r.source) for r in got), key=repr) == sorted(((r[0], r[2]) for r in rows), key=repr)
    hot = [r.copies for r in got if r.doc_id == 7 and r["size"] == 3]
    assert len(hot) >= 900 and max(hot) - min(hot) <= 1
    for s in "st":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= 1
    assert Counter((r.doc_id, r.text) for r in mixing.mixed(df).collect()) == +Counter({(i, t): sum(r.copies for r in got if (r.doc_id, r["size"]) == (i, len((t or "").split()))) for i, t, _ in set(rows)})


def tasks_with_rows(df, most):
    """How many tasks have rows; none has more than `most`."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= most
    return len(sizes)


def test_long_runs_of_equal_rows_are_written_by_many_tasks(spark):
    n = 3_000_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        equal = spark.range(n).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
        rest = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("t").alias("source"))
        df = equal.unionByName(rest)
        taken = mixing.mixed(df)
        counts = {r.source: r.n for r in taken.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert counts["t"] == 80 and n < counts["s"] <= 2 * n and tasks_with_rows(taken, n) > 4
        copies = mixing.with_copies(df)
        assert copies.count() == n + 40 and copies.agg(F.sum("copies")).first()[0] == sum(counts.values())
        sharded = sharding.with_shard(df, "doc_id", 16)
        by_shard = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("d")).collect()
        assert len(by_shard) == 16 and {r.n for r in by_shard} <= {(n + 40) // 16, (n + 40) // 16 + 1} and all((r.a, r.b, r.d) == (0, r.n - 1, r.n) for r in by_shard)
        assert tasks_with_rows(sharded, n // 2) > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# ---- SimHash


def expected_components(rows, width=4, radius=4):
    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 10**9), r[0])
    return [(r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)]


def test_near_duplicates(docs, rows, no_docs):
    got = [(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()]
    want = expected_components(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, _, c in want if c is not None})
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("block_rows", [5, 4096])
def test_components_of_dense_and_chained_fingerprints(spark, block_rows):
    import random

    rng = random.Random(3)
    fps = {0}
    for center in (rng.getrandbits(64) for _ in range(6)):
        chain = center
        for _ in range(60):
            chain ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(chain)
            fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    roots = {r.fp: r.root for r in simhash.fingerprint_components(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, block_rows).collect()}
    up = {x: x for x in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                x, y = sorted((find(signed[i]), find(signed[j])))
                up[y] = x
    assert {x: roots.get(x, x) for x in signed} == {x: find(x) for x in signed}


def test_masks_cover_every_pair():
    import itertools

    masks = simhash.covering_masks(2, 12)
    assert len(masks) == 7
    for r in (1, 2):
        for bits in itertools.combinations(range(12), r):
            assert any(not m & sum(1 << b for b in bits) for m in masks)


# ---- decontamination


def expected_hits(text, items, window=10):
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, ids = lower(text), set(), []
    for item_id, item in items:
        w = lower(item)
        n = min(window, len(w))
        spans = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        at = [i for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in spans] if n else []
        hit.update(j for i in at for j in range(i, i + n))
        if at:
            ids.append(str(item_id))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, rows, no_docs):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 40]
    part = lambda t, a, n: " ".join(t.split()[a : a + n])
    items = [(i, part(t, 3 * i % 9, n)) for i, (t, n) in enumerate(zip(texts, [10, 11, 9, 25, 14, 3, 30, 12, 1, 19] * 2, strict=False))]
    items += [(90, None), (91, ""), (92, items[3][1]), (93, part(texts[2], 0, 9) + " zz " + part(texts[2], 9, 9)), (94, part(texts[4], 0, 16).upper() + "!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contamination(docs, table).collect()]
    want = [(r[0], *expected_hits(r[1], items)) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {x[-1] for x in want} == {True, False}
    kept = decontaminate.without_contaminated(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in want)
    assert decontaminate.contamination(no_docs, table).count() == 0
    assert decontaminate.contamination(docs, table.where("false")).where("contaminated or n_items > 0").count() == 0


def test_repeated_words_meet_once(spark):
    """Runs of equal words, in documents and items, and passages that many documents share."""
    run, passage = "ja " * 5000, " ".join(f"w{i}" for i in range(14))
    docs = [(i, f"x{i} {passage} y{i}") for i in range(300)] + [(1000, run), (1001, "nein " + "ja " * 9), (1002, "ja " * 10 + "nein"), (1003, run + passage)]
    items = [(1, "ja " * 500), (2, passage), (3, passage + " z"), (4, "ja " * 12), (5, "a " + passage)]
    table = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in decontaminate.contamination(df, table).collect()]
    assert sorted(got) == sorted((i, *expected_hits(t, items)) for i, t in docs)
    spots = decontaminate._places(decontaminate.fingerprinted(df.where("doc_id = 1000"), ["doc_id"], "text", (), None, 10, 5, False), "doc_id")
    met = decontaminate.hits(spots, decontaminate._places(decontaminate.fingerprinted(table, ["item_id"], "text", (), None, 10, 5, True), "item_id"))
    assert spots.count() > 4900 and met.count() < 400  # of 4,991 places in the run and 491 in the item


def test_winnowing_keeps_a_hash_in_every_window():
    import numpy as np

    grams = np.random.default_rng(1).integers(0, 7, 300).astype(np.uint64)
    kept = set(decontaminate.winnow(grams, 6).tolist())
    for i in range(295):
        window = grams[i : i + 6]
        assert i + 5 - int(np.argmin(window[::-1])) in kept
    assert len(decontaminate.winnow(grams[:0], 6)) == 0


# ---- line dedup


def expected_chunks(text):
    """Lines and chunks by the rules in plain integers."""
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    lines = text.split("\n")
    h = [xxhash.xxh64_intdigest(x.encode(), 11) for x in lines]
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
    out = set()
    for rule in range(3):
        start = 0
        for i in range(len(lines)):
            rolled = mixed(h[i] * 0x9E3779B97F4A7C15 + (h[i - 1] if i else 0) & mask)
            if not rolled >> rule & 1 or i == len(lines) - 1:
                n = sum(words[start : i + 1])
                if n >= 40 or n >= 10 and i + 1 - start >= 2:
                    out.add((start, i + 1))
                start = i + 1
    worded = [i for i, n in enumerate(words) if n]
    starts = set()
    for at, i in enumerate(worded):
        near = [j for j in worded[at:] if sum(words[i : j + 1]) <= 16] or [i]
        starts.add(min(near, key=lambda j: (mixed(h[j]), -j)))
    for i in starts:
        after = next((j for j in range(i + 1, len(lines) + 1) if sum(words[i:j]) >= 40), None)
        out |= {(i, after)} if after else set()
    return lines, out


def expected_lines(rows):
    """Chunks by their rules, repeats by their bytes, and what is equal around them: 16 words at most before, 40 behind."""
    places, lines_of = {}, {}
    for r in rows:
        lines, parts = expected_chunks(r[1] or "")
        spot = (r[0] if r[0] is not None else -1, xxhash.xxh64_intdigest((r[1] or "").encode(), 42))
        lines_of[spot] = lines
        for a, b in parts:
            places.setdefault("\n".join(lines[a:b]), set()).add((*spot, a, b))
    cut = defaultdict(set)
    count = lambda lines: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines)
    for spots in places.values():
        (doc0, key0, a0, b0), *others = sorted(spots, key=lambda s: (s[0], s[1] - (1 << 64) if s[1] >> 63 else s[1], s[2]))
        first = lines_of[doc0, key0]
        for doc, key, a, b in others:
            own, i, j = lines_of[doc, key], 0, 0
            while a > i and a0 > i and own[a - i - 1] == first[a0 - i - 1] and count(first[a0 - i - 1 : a0]) <= 16:
                i += 1
            while b + j < len(own) and b0 + j < len(first) and own[b + j] == first[b0 + j] and count(first[b0 : b0 + j + 1]) <= 40:
                j += 1
            cut[doc, key].update(range(a - i, b + j))
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None))
            continue
        gone = cut[r[0] if r[0] is not None else -1, xxhash.xxh64_intdigest(r[1].encode(), 42)]
        out.append((r[0], "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone)))
    return out


def test_line_dedup(docs, rows, no_docs):
    out = line_dedup.without_repeats(docs)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(expected_lines(rows), key=repr)
    passages = [r[0] for r in rows if r[0] is not None and r[0] % 10 == 3]
    cut = {r.doc_id: r.n_cut_lines for r in out.collect()}
    # The passage has 84 words in six lines: all of them go, everywhere but once.
    assert all(cut[i] == 6 for i in passages[1:]) and cut[passages[0]] == 0
    assert line_dedup.without_repeats(no_docs).count() == 0
    assert set(docs.columns) - {"text"} <= set(out.columns)


def test_boundaries_survive_insertions():
    import random

    rng = random.Random(2)
    lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) for _ in range(9)) for _ in range(60)]
    of = lambda x: {b"\n".join(rows[a:b]) for rows, parts in [line_dedup.chunks("\n".join(x).encode())] for a, b in parts}
    a, b = of(lines), of(["new line here", *lines[:30], "another one", *lines[30:]])
    assert len(a & b) > 0.8 * len(a)


# ---- WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://a.example/{i} x\n" if i % 3 else None, None if i % 11 == 0 else "" if i % 11 == 1 else f"<p>é {i % 7}</p>\r\n\r\n" * (i % 7 + 1)) for i in range(120)] + [(500, "u", "ß" * 200_000), (7, "u", "again"), (7, "u", "again"), (3, "u", "again")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/archive"
    index = warc.write_archive(df, folder, file_bytes=4000)
    got = warc.read_archive(index, folder, payloads=True, most=3000).collect()
    first = {}
    for page_id, _, html in pages:
        first[html or ""] = min(first.get(html or "", 10**9), page_id)
    want = []
    for page_id, _, html in pages:
        data, ref = (html or "").encode(), first[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page_id, len(data), digest, *(("response", None, data) if ref == page_id else ("revisit", ref, None))))
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert warc.read_archive(index, folder, task_bytes=2000).rdd.getNumPartitions() >= sum(f.stat().st_size for f in Path(tmp_path, "archive").iterdir()) // 2000
    # Every revisit names a response that is in the archive, with its target.
    fields = [warc.parse(gzip.decompress(open(r.file, "rb").read()[r.offset : r.offset + r.length]))[0] for r in index.collect()]
    responses = {f["WARC-Record-ID"]: f for f in fields if f["WARC-Type"] == "response"}
    revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert len(revisits) > 50 and not {f["WARC-Record-ID"] for f in revisits} & set(responses)
    for f in revisits:
        to = responses[f["WARC-Refers-To"]]
        assert to["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and to["WARC-Target-URI"] == f["WARC-Refers-To-Target-URI"] and to["WARC-Date"] == f["WARC-Refers-To-Date"] and to["WARC-Page-ID"] == f["WARC-Refers-To-Page-ID"]
    clash = warc.write_archive(df.selectExpr("*", "1 AS file", "'x' AS digest", "map('a', 1) AS payload", "2 AS refers_to"), f"{folder}2")
    assert sorted(((r.page_id, r.digest, r.record_type) for r in clash.collect()), key=repr) == sorted(((r.page_id, r.digest, r.record_type) for r in index.collect()), key=repr)
    some = index.where("page_id % 10 = 0")
    assert {r.page_id for r in warc.read_archive(some, folder).collect()} == {r[0] for r in pages if r[0] % 10 == 0}
    files = list(Path(tmp_path, "archive").iterdir())
    assert len(files) > 3
    whole = gzip.decompress(files[0].read_bytes())
    assert whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")
    assert warc.write_archive(df.where("false"), folder).count() == 0


def test_ranges_coalesce_neighbours():
    assert warc.ranges([(100, 10), (0, 50), (50, 20), (75, 5), (1000, 5)], 8, 1000) == [[(0, 50), (50, 20), (75, 5)], [(100, 10)], [(1000, 5)]]
    assert [len(x) for x in warc.ranges([(i * 10, 10) for i in range(10)], 0, 30)] == [3, 3, 3, 1]


def test_texts_of_25000_words(spark):
    """Lengths, fingerprints, quality and repeated lines of whole long texts."""
    from test_row_operators import expected_quality

    from tallyforge.llm import quality, token_counts

    words = [f"w{i * 7919 % 9001}" for i in range(25_000)]
    long = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    rows = [(1, long), (2, long + " x"), (3, long[len(long) // 2 :] + "\n" + long[: len(long) // 3]), (4, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    assert {r.doc_id: r.length for r in token_counts.with_length(docs, keep=["doc_id"]).collect()} == {i: len(encode(t)) for i, t in rows}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.with_quality(docs).collect()}
    assert got == {i: expected_quality(t) for i, t in rows}
    assert sorted((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()) == sorted(expected_components(rows))
    cut = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert sorted(cut.items()) == sorted(expected_lines(rows)) and len(cut[2]) < 100 and len(cut[3]) < 1000
