import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sparkchirp.llm import neardup
from sparkchirp.llm.components import components


def shingle_set(text, width=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows, least=0.8):
    """Class of every row: the smallest id reached by links of similarity or equal texts."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (a and len(a & sets[j]) >= least * len(a | sets[j]) - 1e-9):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]


def corpus(seed, bases=40, copies=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(bases):
        base = [word() for _ in range(rng.choice([2, 4, 5, 40, 150]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            v = list(base)
            for _ in range(rng.randint(0, max(1, len(v) // 50))):
                v[rng.randrange(len(v))] = word()
            out.append(" ".join(v))
    return out + [None, "", " ", out[3], out[3]]


def same_classes(got, rows, want):
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.id].append(r.class_id)
    for (i, _), c in zip(rows, want, strict=True):
        if i is not None:
            assert set(by[i]) == {c}, i


def test_classes_equal_brute_force(spark):
    rows = list(enumerate(corpus(1))) + [(3, "word one two"), (None, "no id here at all"), (None, "no id here at all")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, class_id int, kept string").repartition(4)
    rows[-3] = (-3, rows[-3][1])  # the repeated id has two texts: checked apart
    got = [r for r in neardup.near_duplicates(docs).collect()]
    want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
    for r in got:
        if r.id not in (None, 3):
            assert r.class_id == want[r.id]
    keepers = [(r.class_id, r.id) for r in got if r.kept]
    assert all(c == i for c, i in keepers) and len({r.class_id for r in got}) <= len(keepers)
    assert [r.kept for r in got if r.sha == next(x.sha for x in got if x.id is None)].count(True) == 1
    kept = neardup.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_split_clusters_lose_no_link(spark):
    """A chain of texts, each similar only to its neighbours, and a dense group, in blocks of a few texts."""
    words = [f"w{i}" for i in range(1200)]
    chain = [" ".join(words[i * 10 : i * 10 + 100]) for i in range(60)]  # neighbours share 86 of 106 shingles
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    dense = []
    for i in range(60):
        v = list(base)
        v[rng.randrange(80)] = f"e{i}"
        dense.append(" ".join(v))
    rows = list(enumerate(chain + dense))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(set(want)) == 2
    for block in (7, 256):
        same_classes(neardup.near_duplicates(docs, block=block).collect(), rows, want)


def test_very_long_texts_and_repeats(spark):
    """Long texts are compared whole; texts with the same shingles but other numbers of repeats stay candidates."""
    long = [f"w{i * 7919 % 60_013}" for i in range(50_000)]
    late = long[:40_000] + [f"x{i}" for i in range(10_000)]  # 40,000 of 60,000 shingles in common
    near = long[:-500] + [f"y{i}" for i in range(500)]
    loop = [f"l{i}" for i in range(30)]
    rows = list(enumerate([" ".join(x) for x in (long, late, near, loop * 2, loop * 40, loop * 3 + ["end"])]))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int")
    got = {r.id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == dict(zip(range(6), brute(rows), strict=True)) == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 3}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(none).count() == 0 and neardup.near_dedup(none).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    key = rng.integers(0, 2**63, 400).astype(np.uint64)
    w1, w2 = rng.integers(1, 9, 400).astype(float), rng.integers(1, 9, 400).astype(float)
    w2[:150] = w1[:150]
    w1[380:], w2[:20] = 0, 0
    use = [np.flatnonzero(w1), np.flatnonzero(w2)]
    doc = np.concatenate([np.zeros(len(use[0]), int), np.ones(len(use[1]), int)])
    sig = neardup.dart_minhash(doc, np.concatenate([key[u] for u in use]), np.concatenate([w1[use[0]], w2[use[1]]]), 3, 4000)
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03
    assert (sig[2] == ~np.uint64(0)).all() and not (sig[:2] == ~np.uint64(0)).any()


def test_signature_does_not_depend_on_the_batch():
    key = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    alone = neardup.dart_minhash(np.zeros(59, int), key, None, 1, 50)
    doc = np.concatenate([np.zeros(59, int), np.ones(3, int)])
    both = neardup.dart_minhash(doc, np.concatenate([key, key[:3]]), None, 2, 50)
    assert np.array_equal(alone[0], both[0])


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 50)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    joined = {x for a, b in edges if a != b for x in (a, b)}
    for few in (0, 1000):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert got == {x: find(x) for x in joined}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_reach_needs_no_pairs():
    sets = [np.unique(np.arange(i, i + 20, dtype=np.uint64)) for i in range(30)]
    assert neardup.reach(sets, 0.9).tolist() == [0] * 30
    assert len(set(neardup.reach(sets, 0.95).tolist())) == 30
