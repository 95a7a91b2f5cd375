"""Ranked search, sketches and periodic runs against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orebook.llm import periodic, ranked, sketch
from orebook.llm.queries import QUERIES
from tests.llm.test_text_scans import words


def brute_ranks(docs, items, top):
    counts = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for key, text in items:
        scored = []
        for i, c in counts:
            n = sum(c.values())
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(words(text)) if t in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(key, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("top", [1, 5, 50])
def test_ranks_equal_brute_force(spark, tmp_path, top):
    draw = random.Random(21)
    text = lambda n: " ".join(draw.choice(["a", "b", "C", "dé", "e9", "ff", "g-h", "ii", "漢"]) for _ in range(n))
    docs = [(i, text(draw.choice([1, 3, 3, 3, 8, 20, 60]))) for i in range(300)]
    docs += [(400 + i, docs[0][1]) for i in range(60)] + [(5, "a b"), (5, "a b"), (None, "ff ff ii"), (None, "ff"), (600, None), (601, ""), (602, "... !"), (603, "zz " * 5000)]
    items = [(i, text(draw.randint(1, 9))) for i in range(6)] + [(10, "zz"), (11, "none of these"), (12, None), (13, "!"), (0, "a"), (None, "ff 漢")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, terms string")
    asked = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    want = brute_ranks(docs, items, top)
    for shard_terms, block_bytes in ((10**6, 10**6), (200, 12)):
        index = ranked.build(df, str(tmp_path / f"index{shard_terms}"), shard_terms=shard_terms)
        got = ranked.search(index, asked, top, block_bytes=block_bytes).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert index.read(spark, "documents").groupBy("shard").count().agg(F.max("count")).first()[0] < 300


def test_strata_left_out_change_nothing():
    draw = random.Random(22)
    for _ in range(40):
        n = draw.randint(1, 300)
        m = np.sort(np.array([draw.choice([50, 60, 60, 90, 400]) for _ in range(n)]))
        terms = "abcdef"
        numbers = [np.array(sorted(draw.sample(range(n), draw.randint(1, n)))) for _ in terms]
        tfs = [np.array([draw.choice([1, 1, 1, 2, 9]) for _ in x]) for x in numbers]
        by = [np.lexsort((x, t, m[x])) for x, t in zip(numbers, tfs)]
        shard = ranked.Shard(list(terms), [x[b] for x, b in zip(numbers, by)], [t[b] for t, b in zip(tfs, by)], m)
        weights = [(t, draw.randint(0, 50)) for t in "abcx"]
        score = np.zeros(n, np.int64)
        for t, w in weights:
            if t in terms:
                x, tf = numbers[terms.index(t)], tfs[terms.index(t)]
                score[x] += w * ranked.impact(tf, m[x])
        for top in (1, 3, 50):
            found, scores = shard.best(weights, top)
            assert (score[found] == scores).all()
            least = max(1, np.sort(score)[::-1][:top][-1])
            assert set(np.flatnonzero(score >= least)) <= set(found)


def test_empty_tables_have_no_ranks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.rank_all(df.limit(0), items).count() == 0
    assert ranked.rank_all(df, items.limit(0)).count() == 0
    assert ranked.rank_all(df.where("doc_id = 1").withColumn("text", F.lit(None).cast("string")), items).count() == 0


def brute_sketch(text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    spans = [w[i:i + 5] for i in range(max(1, len(w) - 4))] if w else []
    hashes = set()
    for some in spans:
        seed = 42
        for x in some:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        hashes.add(seed >> 2)
    hashes = sorted(hashes)
    low = [h for h in hashes if h < 2**62 // 8]
    if len(low) >= 16:
        return 2**62 // 8, low
    return (2**62, hashes) if len(hashes) <= 16 else (hashes[15] + 1, hashes[:16])


def brute_likeness(a, b):
    t = min(a[0], b[0])
    x, y = {h for h in a[1] if h < t}, {h for h in b[1] if h < t}
    return len(x & y) / len(x | y) if x | y else 1.0


def printed(one):
    return f"{one[0]:X}:" + ",".join(f"{h:X}" for h in one[1])


def test_fingerprints_equal_brute_force(spark, tmp_path):
    draw = random.Random(23)
    text = lambda n: "".join(draw.choice(["ab", "c", "é", "😀", "dd"]) + draw.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n))
    texts = [text(draw.choice([0, 1, 3, 5, 9, 40, 300, 900])) for _ in range(150)] + ["", None, " \n", "x" * 9, text(20_000)]
    ids = draw.sample(range(-500, 5000), len(texts))
    spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, own string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op12_scaled_sketches"](spark, str(tmp_path)).collect()}
    order = sorted(zip(ids, texts))
    assert len(got) == len(order)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt, r = t or "", nxt or "", got[i]
        moved = len(t) // 4
        edited = t[:len(t) - moved] + nxt[:moved]
        own, new, follows = brute_sketch(t), brute_sketch(edited), brute_sketch(nxt)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (printed(own), printed(new))
        assert r.near_edited == pytest.approx(brute_likeness(own, new)) and r.near_next == pytest.approx(brute_likeness(own, follows))


def test_next_text_of_repeated_and_missing_ids(spark):
    rows = [(1, "aaaa"), (1, "bbbbbbbb"), (3, "zz"), (3, "yy"), (None, "cccc"), (None, None), (9, "dddd")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, edited string")
    got = sorted((r.doc_id or 0, r.text, r.edited) for r in sketch.compare_with_next(df).collect())
    assert got == sorted([(1, "aaaa", "aaay"), (1, "bbbbbbbb", "bbbbbbyy"), (3, "zz", "zz"), (3, "yy", "yy"), (0, "cccc", "ccc"), (0, "", ""), (9, "dddd", "ddda")])
    assert sketch.compare_with_next(df.limit(0)).count() == 0
    alone = sketch.compare_with_next(df.where("doc_id = 9")).collect()
    assert [(r.edited, r.following == r.own) for r in alone] == [("dddd", True)]


def test_estimates_between_unequal_texts_and_merges(spark):
    draw = random.Random(24)
    large = [str(draw.randint(0, 10**9)) for _ in range(20_000)]
    rows = [(" ".join(large), " ".join(large[500:1500])), (" ".join(large[:9000]), " ".join(large[6000:])), ("a b c", "a b c"), ("", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    s = sketch.with_sketch(sketch.with_sketch(df, "a", "sa"), "b", "sb")
    a, b = F.col("sa"), F.col("sb")
    both = s.withColumn("all", sketch.merge(a, b)).select(
        sketch.containment(b, a), sketch.likeness(a, b), sketch.containment(a, F.col("all")), F.col("all.kept"), "sa.kept", "sb.kept").collect()
    assert both[0][0] == 1.0 and both[0][1] == pytest.approx(0.05, abs=0.02)
    assert both[1][0] == pytest.approx(3000 / 14000, abs=0.05)
    assert all(r[2] in (1.0, None) for r in both) and both[2][:2] == (1.0, 1.0) and both[3][0] is None and both[3][1] == 1.0
    assert both[1][3] == sorted(set(both[1][4]) | set(both[1][5]))


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def with_repeats(draw, w):
    for _ in range(draw.randrange(3)):
        a, p = draw.randrange(len(w)), draw.randrange(1, max(2, len(w) // 5))
        for i in range(a, draw.randrange(a, len(w) + 1)):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_equal_brute_force(monkeypatch):
    draw = random.Random(25)
    for head in (2**15, 4):
        monkeypatch.setattr(periodic, "HEAD", head)
        for _ in range(400):
            w = with_repeats(draw, [draw.randrange(draw.choice([1, 2, 3, 9, 60])) for _ in range(draw.randint(1, 130))])
            assert periodic.runs_of(np.array(w)) == brute_runs(w)


def test_transforms_are_exact():
    draw = np.random.default_rng(26)
    for prime, generator in periodic.PRIMES:
        assert pow(generator, (prime - 1) // 2, prime) == prime - 1 and (prime - 1) % 2**25 == 0
    for c in (1, 2, 8, 64):
        block = draw.integers(0, 3, (5, c)) * 10**9
        window = draw.integers(0, 3, (5, 2 * c - 1)) * 10**9
        window[0, c - 1:] = block[0]
        got = periodic.zero_distances(block, window, 3 * 10**9)
        assert (got == [[(window[r, d:d + c] == block[r]).all() for d in range(c)] for r in range(5)]).all()


def test_hard_sequences_take_little_time():
    for w, n in (([0] * 200_000, 1), (([0] * 1000 + [1]) * 100, 101), ([0] * 99_999 + [1] + [0] * 100_000, 2)):
        assert len(periodic.runs_of(np.array(w))) == n


def test_run_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(27)
    texts = [" ".join(with_repeats(draw, [draw.choice(["a", "b", "É", "d!"]) for _ in range(draw.randint(1, 120))])) for _ in range(300)]
    texts += [None, "", " \n\t", "x " * 5000, "one\x0btwo", "a a a a a a", " lead  and\ttail "]
    rows = list(enumerate(texts, 1000)) + [(None, "b " * 9)]
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op13_block_convolution_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, planted = h // 10, planted + 1
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w))]
        runs = brute_runs(w)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best), (i, w)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert planted > 10 and len(got) == len(rows)


def test_runs_keep_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", "r", 5), (1, "a a a a a a b", "r", 5), (2, None, None, None)], "doc_id long, text string, runs string, start int")
    got = periodic.find_runs(df).collect()
    assert [(r.doc_id, r.start, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (1, 5, 7, [(0, 6, 1)], "a b"), (1, 5, 7, [(0, 6, 1)], "a b"), (2, None, 0, [], "")]
    assert periodic.find_runs(df.limit(0)).count() == 0
