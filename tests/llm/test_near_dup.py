"""Near duplicates, components and the vector forest against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebook.llm import components, forest, near_dup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def groups(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, groups(ids, links)


def corpus(seed):
    """Copies, and near copies with few to many edits of an original that is not the smallest id."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, origin = [], [draw.choice(words) for _ in range(120)]
    for i in range(160):
        text = list(origin)
        for _ in range(draw.randint(0, 9)):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, rows[0][1].upper()) for i in range(40)]
    for i in range(60):
        base = [draw.choice(words) for _ in range(draw.randint(1, 60))]
        rows += [(3000 + 3 * i, " ".join(base)), (3001 + 3 * i, "  ".join(base)), (3002 + 3 * i, " ".join(base[:-1] + ["end"]))]
    return rows + [(4000, ""), (4001, None), (4002, " \n\t"), (4003, "a"), (4004, "A"), (4005, " ")]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, size, percent):
    rows = corpus(size)
    sets, want = brute(rows, size, percent)
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, kept long")
    got = near_dup.near_duplicates(df, shingle=size, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    left = near_dup.drop_near_duplicates(df, shingle=size, percent=percent)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, g in want.items() if i == g)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = corpus(11)
    sets, want = brute(rows, 3, 85)
    docs = spark.createDataFrame(rows, "id long, text string")
    everything = docs.where("id <= 1000").selectExpr("1L as bucket", "160L as size", "id")
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    links = near_dup._compare_in_blocks(everything, docs, 3, 85).collect()
    assert all(100 * len(sets[r.a] & sets[r.b]) >= 0 and want[r.a] == want[r.b] for r in links)
    ids = [i for i, _ in rows if i <= 1000]
    only = brute([x for x in rows if x[0] <= 1000], 3, 85)[1]
    assert groups(ids, [(r.a, r.b) for r in links]) == only


def test_nulls_repeats_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.near_duplicates(none).count() == 0
    assert near_dup.drop_near_duplicates(none).count() == 0
    df = spark.createDataFrame([(None, "one two three"), (5, "one two three"), (5, "one two three"), (None, "alone here now"),
                                (None, "alone here now"), (None, None), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == sorted([("None", "5", False), ("5", "5", True), ("5", "5", True), ("None", "None", True), ("None", "None", True),
                          ("None", "None", True), ("7", "7", True)])
    left = sorted((str(r.doc_id), str(r.text)) for r in near_dup.drop_near_duplicates(df).collect())
    assert left == sorted([("5", "one two three"), ("None", "alone here now"), ("None", "None"), ("7", "None")])


def test_signature_estimates_similarity():
    draw = np.random.default_rng(1)
    common, a, b = (draw.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))
    signed = near_dup.super_minhash([x, y, x[:3], np.empty(0, np.uint64)], 256)
    assert abs((signed[0] == signed[1]).mean() - 0.8) < 0.1
    assert np.isinf(signed[3]).all() and np.isfinite(signed[2]).all()


def test_components_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_LINKS", 40)
    draw = random.Random(5)
    links = [(i, i + 1) for i in range(120)] + [(500, 500 + i) for i in range(1, 90)] + [(draw.randint(900, 990), draw.randint(900, 990)) for _ in range(40)]
    links += [(3, 3), (4, 3)]
    df = spark.createDataFrame(links + [(None, 3), (3, None)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.components(df, "a", "b").collect()}
    want = groups({n for p in links for n in p}, links)
    assert got == {n: g for n, g in want.items() if n != g}
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((500, 32))
    x[100:160] = x[100] + 0.15 * draw.standard_normal((60, 32))
    x[200:230] = x[200]
    x[300] = 3 * x[301]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    y = np.array([v for _, v in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    np.fill_diagonal(near, False)
    want = groups(range(500), [tuple(p) for p in np.argwhere(near)])
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] + [1.0] * 31), (904, [None] + [1.0] * 31),
           (905, [float("inf")] + [1.0] * 31), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (None, [5.0, -1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, kept int")
    got = {r.vec_id: r for r in forest.near_vectors(df, leaf=64, block=40).collect()}
    assert len(got) == 509
    assert all(got[i].n_links == near[i].sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(500))
    assert [got[i].n_links for i in range(900, 908)] == [0] * 6 + [1, 1]
    assert all(got[i].component_id == i for i in range(900, 907)) and got[907].component_id == 906
    assert got[None].component_id is None
    assert forest.near_vectors(df.limit(0)).count() == 0


def test_forest_recall_on_borderline_pairs():
    """Pairs right at the limit, the worst case, through trees seven levels deep."""
    draw = np.random.default_rng(3)
    a = draw.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = draw.standard_normal((3000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    met = np.zeros(3000, bool)
    for tree in range(forest.TREES):
        cuts = forest.fit(a, 7, tree, 0.9)
        leaves = [[set() for _ in range(3000)] for _ in range(2)]
        for k, x in enumerate((a, b)):
            for node, rows in forest.route(x, cuts, tree, 0.9):
                for r in rows:
                    leaves[k][r].add(node)
        met |= [bool(p & q) for p, q in zip(*leaves)]
    assert met.mean() >= 0.99


def test_crowded_leaves_grow_and_lose_no_link(spark):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((6000, 24))
    x[:500] = x[0] + 0.12 * draw.standard_normal((500, 24))  # a dense leaf, which no split parts
    twins = np.arange(1000, 1800)
    x[twins] = x[twins + 1000] + 0.25 * draw.standard_normal((800, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000 + i, v[:3].tolist()) for i, v in enumerate(x[4000:4900])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in forest.near_vectors(df, leaf=100, block=90, sample=80).collect()}
    for part in ([r for r in rows if r[0] < 9000], [r for r in rows if r[0] >= 9000]):
        y = np.array([v for _, v in part])
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        near = y @ y.T >= 0.9
        np.fill_diagonal(near, False)
        links = np.array([got[i].n_links for i, _ in part])
        assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.999 * near.sum() > 0

    packed, kind = forest.packed(df.selectExpr("vec_id as id", "embedding as v"), "v")
    classes = packed.selectExpr("id as digest", "vec", "1L as n").where("digest < 9000")
    sent = spark.sparkContext.broadcast(forest._fit(classes, kind, 0.9, 6, 100, 80))
    routed = forest._routed(classes, sent, kind, 0.9, 6)
    grown = forest._grown(classes, routed, kind, 0.9, 100)
    sizes = [[(r.n, r.dense) for r in t.selectExpr("digest", "explode(leaves) as leaf").groupBy("leaf").agg(
        F.count("digest").alias("n"), F.sum((F.col("digest") < 500).cast("int")).alias("dense")).collect()] for t in (routed, grown)]
    assert grown.columns == routed.columns and grown.count() == 6000
    assert max(n for n, dense in sizes[0] if dense < 100) > 800 and max(sizes[0])[0] > 2000
    assert all(n <= 400 or dense > 100 for n, dense in sizes[1]) and max(sizes[1])[0] < 1500


def test_links_of_rows_that_share_an_id_or_have_none(spark):
    draw = random.Random(31)
    base = [str(draw.randint(0, 10**9)) for _ in range(60)]
    near = [*base[:59], "other"]
    other = [str(draw.randint(0, 10**9)) for _ in range(60)]
    far = [str(draw.randint(0, 10**9)) for _ in range(40)]
    rows = [(1, base), (2, near), (2, ["0", *far]), (None, [*other[:59], "x"]), (None, other), (7, far[:30])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_dup.near_duplicates(df, shingle=3, percent=85).collect())
    assert got == sorted([(1, 58, 1), (2, 58, 1), (2, 39, 2), (0, 58, 0), (0, 58, 0), (7, 28, 7)])
    kept = near_dup.drop_near_duplicates(df, shingle=3, percent=85).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 7]


def crowd(seed, count):
    """Texts of one origin, each with edits of its own: most below the limit to all others, ten linked."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(10**6)]
    origin, rows = [draw.choice(words) for _ in range(150)], []
    for i in range(count):
        text = list(origin)
        for at in draw.sample(range(150), 1 if i < 10 else 6):
            text[at] = draw.choice(words)
        rows.append((i, " ".join(text[:draw.randint(140, 150)])))
    return rows


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80), (1, 90)])
def test_rare_shingles_bring_linked_texts_together(spark, size, percent):
    rows = [r for r in corpus(7) if shingles(r[1], 1)] + [(10_000 + i, t) for i, t in crowd(8, 150)]
    rows += [(20_000 + k, " ".join("abcdefghijklmnopqrstuvwxyz"[:k])) for k in range(1, 26)]
    sets = {i: shingles(t, size) for i, t in rows}
    docs = spark.createDataFrame(rows, "id long, text string")
    buckets = {}
    for r in near_dup._by_rare_shingles(docs, size, percent).collect():
        buckets.setdefault(r.bucket, ([], []))[0 if r.short else 1].append(r.rep)
    together = {(min(a, b), max(a, b)) for some, rest in buckets.values() for a in some for b in some + rest}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
              if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert linked and all(p in together for p in linked)


def test_crowded_buckets_are_dealt_by_rare_shingles(spark, monkeypatch):
    """Shuffled rows grow with the number of documents; groups are those of brute force."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "WIDE", 2)
    sent, seen = [], []
    plain, deal = near_dup._parts, near_dup._by_rare_shingles

    def counted(mixed):
        sent[-1] += plain(mixed).count()
        return plain(mixed)

    def dealt(texts, *rest):
        seen.append(texts.count())
        return deal(texts, *rest)

    monkeypatch.setattr(near_dup, "_parts", counted)
    monkeypatch.setattr(near_dup, "_by_rare_shingles", dealt)
    for count in (150, 300):
        rows = crowd(9, count)
        sent.append(0)
        _, want = brute(rows, 3, 85)
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
        assert {r.doc_id: r.component_id for r in got} == want and 1 < len(set(want.values()))
    assert len(seen) == 2 and all(n > 100 for n in seen)
    assert 0 < sent[1] <= 2.5 * sent[0]


def test_long_documents_make_more_blocks(spark):
    shared = spark.createDataFrame([(1, 10, 3), (1, 11, 3), (1, 12, 3), (2, 10, 2), (2, 13, 2)], "bucket long, rep long, n long")
    groups = spark.createDataFrame([(12, 11), (13, 10)], "node long, component long")
    classes = spark.createDataFrame([(10, 5), (11, 7000), (12, 1), (13, 9)], "rep long, n_shingles long")
    got = near_dup._mixed(shared, groups, classes).collect()
    assert sorted((r.bucket, r.size, r.others, r.id) for r in got) == [(1, 4, 0, 10), (1, 4, 0, 11), (1, 4, 0, 12)]
