import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkchirp.llm import lm, toxicity
from sparkchirp.llm.common import Words, mix
from sparkchirp.llm.exchange import Counted, pack_counts, pack_keys, unpack_counts, unpack_keys
from sparkchirp.llm.threshold import Block, quantised, top_k


def texts(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "the", "cat", "Cat", "dög", "x" * rng.randint(1, 9)])
    return [" \n".join(word() for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)] + [None, "", "\t", "Zz zz"]


def brute(rows, order, strength=None):
    """(tokens, known, N, base, score) of texts, from counts of tuples; the begin of a text is the token 1, its end 0.
    ``strength``: K by order, where not that of these counts."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = [(t, [1, *(x or "").encode().translate(lower).split(), 0]) for x, t in rows]
    count, begins = Counter(), sum(t for t, _ in words)
    for t, v in words:
        if t:
            for i in range(1, len(v)):
                for m in range(1, min(order, i + 1) + 1):
                    count[tuple(v[i - m + 1 : i + 1])] += 1
    total, types = sum(n for k, n in count.items() if len(k) == 1), sum(len(k) == 1 for k in count)
    strength = strength or brute_strength(count)
    out = []
    for _, v in words:
        base = score = 0.0
        for i in range(1, len(v)):
            p = (count[v[i],] + 1) / (total + types + 1)
            base += math.log10(p)
            for m in range(2, min(order, i + 1) + 1):
                h = tuple(v[i - m + 1 : i])
                c = begins if h == (1,) else count[h]
                k = strength[m]
                p = (count[(*h, v[i])] + k * p) / (c + k)
            score += math.log10(p)
        out.append((len(v) - 1, sum(count[x,] > 0 for x in v[1:]), total, base, score))
    return out


def brute_strength(count):
    once, twice = (Counter(len(k) for k, n in count.items() if n == x) for x in (1, 2))
    return {m: (once[m] + 1) / (2 * twice[m] + 1) for m in (2, 3)}


def ngrams(texts, order=3):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = [[1, *(x or "").encode().translate(lower).split(), 0] for x in texts]
    return Counter(tuple(v[i - m + 1 : i + 1]) for v in words for i in range(1, len(v)) for m in range(1, min(order, i + 1) + 1))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "GROUP_BYTES", 700)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 900)
    rows = [(i, t, "s") for i, t in enumerate(texts(1))]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, score string")
    got = lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, order=order)
    learn = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    want = brute([(t, learn(i)) for i, t, _ in [*rows, rows[3]]], order)
    found = {}
    for r in got.collect():
        found.setdefault(r.row.doc_id, []).append(r)
    assert sorted(map(len, found.values())) == [1] * (len(rows) - 1) + [2]
    for i, (n, known, total, base, score) in enumerate(want[:-1]):
        r = found[i][0]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (learn(i), n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
        if learn(i) and i % 5 == 0:  # the same model, but for this text
            strength = brute_strength(ngrams([t for j, t, _ in [*rows, rows[3]] if learn(j)], order))
            without = [(t, learn(j) and k != i) for k, (j, t, _) in enumerate([*rows, rows[3]])]
            score = brute(without, order, strength)[i][4]
        if not learn(i) or i % 5 == 0:
            assert r.left_out_score == pytest.approx(score) and r.left_out_mean == pytest.approx(score / n)


def test_counts_of_any_size_come_back():
    values = np.array([0, 1, 254, 255, 256, 2**40, 3])
    for usual in (0, 1, values[::-1]):
        assert np.array_equal(unpack_counts(pack_counts(values, usual), 7, usual), values)
    assert len(unpack_counts(pack_counts(values[:0], 1), 0, 1)) == 0
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 31, 33, 255, 256, 1000):
        keys = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
        assert np.array_equal(unpack_keys(pack_keys(keys, False), False), keys) and np.array_equal(unpack_keys(pack_keys(keys, True), True), keys)


def test_whole_keys_come_back_by_bucket():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 9, 1000):
        for top in (4 * n + 4, 1 << 40, (1 << 64) - 1):
            keys = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            assert np.array_equal(unpack_keys(pack_keys(keys, True), True), keys)
    for edge in ([0, 2**64 - 1], [2**64 - 2, 2**64 - 1], [0, 1, 2**64 - 1]):
        assert unpack_keys(pack_keys(np.array(edge, np.uint64), True), True).tolist() == edge
    keys = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    for buckets in (1, 7, 60_000):
        dealt = Counted(keys, np.ones(len(keys), np.int64), buckets, True)
        sent = [pack_keys(dealt.keys[dealt.part(b)], True) for b in dealt.bounds]
        assert np.array_equal(np.concatenate([unpack_keys(x, True) for x in sent]), np.sort(keys)) and max(dealt.bounds) < buckets
        assert buckets > 7 or sum(map(len, sent)) < 7 * len(keys)


def test_bigrams_that_share_40_bits_are_counted_apart(spark):
    words = [f"w{i}" for i in range(2500)]
    h = Words(pa.array(words)).hashes(lower=True)
    keys = mix(h[None, :] + lm._ROUND * h[:, None]).ravel()
    low = keys & np.uint64((1 << 40) - 1)
    at = np.argsort(low)
    twin = int(np.flatnonzero(low[at][1:] == low[at][:-1])[0])
    one, other = at[twin : twin + 2].tolist()
    assert keys[one] != keys[other]
    rows = [" ".join([words[k // len(words)], words[k % len(words)]]) for k in (one, other)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.row.doc_id: r.score for r in lm.score_texts(docs, F.lit(True), order=2).collect()}
    assert [got[0], got[1]] == pytest.approx([x[4] for x in brute([(t, True) for t in rows], 2)])


@pytest.mark.parametrize("order", [1, 2, 3])
def test_every_state_is_a_distribution(order):
    """From each numbered state, arcs and failure arcs give all words and one unseen word probabilities that add up to 1."""
    corpus = pa.array(["a b a c", "b b a", "c a b a b", "", "d"], pa.string())
    grams = lm.Grams(corpus, order)
    counts = grams.counts()
    words = counts[0][:-1]
    a = lm.BackoffAutomaton(grams, counts, int(words.sum()), int((words > 0).sum()), [0.7, 2.5][: order - 1])
    pairs = {("^", "a"), ("a", "b"), ("b", "a"), ("a", "c"), ("^", "b"), ("b", "b"), ("^", "c"), ("c", "a"), ("^", "d")}
    assert len(a.fail) == [1, 1 + 5, 1 + 5 + len(pairs)][order - 1]  # the empty context, begin and four words, pairs before the end
    for state in range(len(a.fail)):
        a.start = state
        assert sum(10 ** a.score([x]) for x in range(len(words))) + 10 ** a.score([10**6]) == pytest.approx(1.0)
        assert state == 0 or a.fail[state] < state and a.fail_weight[state] < 0
    assert len(a.weight) == len(a.target) == len(a.arcs) + sum(x >= 0 for x in a.first_arc) and all(0 <= x < len(a.fail) for x in a.target)


def test_very_long_text_is_scored_whole(spark):
    text = " ".join(f"w{i % 701}" for i in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2 w3")], "doc_id long, text string")
    got = {r.row.doc_id: r for r in lm.score_texts(docs, F.col("doc_id") == 1).collect()}
    assert got[1].n_tokens == got[1].train_tokens == 300_001 and got[2].n_known == 4
    assert got[1].score == pytest.approx(brute([(text, True)], 3)[0][4])


def test_scores_without_training_rows_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score_texts(docs, F.lit(False)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}
    clash = spark.createDataFrame([(1, "a b", "x", 3, 4)], "doc_id long, text string, g string, h int, score int")
    assert lm.score_texts(clash, F.lit(None).cast("boolean")).first().row.asDict() == clash.first().asDict()
    assert lm.score_texts(docs.limit(0), F.lit(True)).count() == 0


# --------------------------------------------------------------------------- toxicity
BAD = ["vile", "awful", "foul", "rotten"]


def labelled(spark, n=1500):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(3)) for _ in range(rng.randint(5, 80))]
        grade = rng.choice([0, 0, 0, 1, 2, 3])
        for _ in range(grade):
            words.insert(rng.randint(0, len(words)), BAD[rng.randrange(4)].upper() + rng.choice(["", ".", "!"]))
        seen = len({w.strip(".!") for w in words if w.isupper() or w.strip(".!").isupper()})
        rows.append((i, " ".join(words), "p"))
        marks.append((i, seen))
    return spark.createDataFrame(rows, "doc_id long, text string, severity string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_ordinal_grades_on_held_out_rows(spark):
    docs, marks = labelled(spark)
    model = toxicity.train(docs, marks.where("doc_id < 1000"), F.col("toxic"))
    assert list(model.grades) == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(docs, model).join(marks, F.col("row.doc_id") == F.col("doc_id")).where("doc_id >= 1000").collect()
    assert sum(r.grade == r.toxic for r in got) > 0.9 * len(got)
    assert all(0 <= r.severity <= 3 for r in got) and sum(r.rejected == (r.toxic > 0) for r in got) > 0.97 * len(got)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def likelihood(sets, grade, model, words, l2):
    """The penalised mean negative log likelihood, term by term."""
    weight = dict(zip(words.tolist(), model.weights.tolist(), strict=True))
    edge = [-math.inf, *model.thresholds, math.inf]
    total = 0.0
    for s, g in zip(sets, grade, strict=True):
        eta = sum(weight.get(x, 0.0) for x in s.tolist())
        below = [0.0 if e == -math.inf else 1.0 if e == math.inf else 1 / (1 + math.exp(eta - e)) for e in edge]
        k = list(model.grades).index(g)
        total -= math.log(below[k + 1] - below[k])
    return total / len(sets) + l2 / 2 * sum(w * w for w in weight.values())


def test_fit_has_the_greatest_likelihood():
    rng = np.random.default_rng(1)
    words = np.arange(8, dtype=np.uint64)
    sets = [np.unique(rng.integers(0, 8, 3)).astype(np.uint64) for _ in range(300)]
    grade = np.array([min(2, int((s < 3).sum() + (rng.random() < 0.2))) for s in sets])
    indptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    model = toxicity.fit(indptr, np.concatenate(sets).astype(int), grade, words, l2=1e-2)
    assert set(np.argsort(-model.weights)[:3].tolist()) == {0, 1, 2}
    best = likelihood(sets, grade, model, words, 1e-2)
    for part in (model.weights, model.thresholds):
        for i in range(len(part)):
            for step in (0.01, -0.01):
                part[i] += step
                assert likelihood(sets, grade, model, words, 1e-2) > best
                part[i] -= step
    p = model.probabilities(np.array([0.0, 50.0, -50.0]))
    assert np.allclose(p.sum(axis=1), 1) and p[1, 2] > 0.99 and p[2, 0] > 0.99


def test_model_is_a_function_of_the_rows(spark):
    docs, marks = labelled(spark, 900)
    docs = docs.union(docs.limit(300))
    seen = set()
    for d, m in ((docs.coalesce(1), marks), (docs.repartition(7), marks.repartition(3)), (docs.orderBy(F.desc("doc_id")), marks.orderBy(F.rand(3)))):
        model = toxicity.train(d, m, F.col("toxic"), sample_rows=600)
        got = toxicity.score(docs.repartition(2), model).select("row.doc_id", "severity").distinct().orderBy("doc_id").collect()
        seen.add((model.words.tobytes(), model.weights.tobytes(), model.thresholds.tobytes(), tuple(r.severity for r in got)))
    assert len(seen) == 1 and len(got) == 900


def test_very_long_text_and_clashing_names_in_toxicity(spark):
    docs, marks = labelled(spark, 400)
    model = toxicity.train(docs, marks, F.col("toxic"))
    long = spark.createDataFrame([(1, "aei ous " * 150_000 + "VILE awful foul rotten", 3, "g"), (2, "aei", 4, "h")], "doc_id long, text string, grade int, row string")
    got = {r.row.doc_id: r for r in toxicity.score(long, model).collect()}
    assert got[1].rejected and not got[2].rejected and got[1].row.row == "g"
    assert toxicity.drop_toxic(long, model).collect() == long.where("doc_id = 2").collect()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "vile"), (3, "vile")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for marks in (none, spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int")):
        model = toxicity.train(docs, marks, F.col("toxic"))
        assert [r.severity for r in toxicity.score(docs, model).collect()] == [0.0] * 4
    assert toxicity.score(docs.limit(0), model).count() == 0
    ones = spark.createDataFrame([(1, 2), (2, 2)], "doc_id long, toxic int")
    assert {r.severity for r in toxicity.score(docs, toxicity.train(docs, ones, F.col("toxic"))).collect()} == {2.0}


def test_copies_do_not_count_as_evidence():
    a, b = np.arange(50, dtype=np.uint64), np.arange(100, 150, dtype=np.uint64)
    near = a.copy()
    near[3] = 999
    rows = np.array([toxicity.least_hashes(x) for x in (a, b, a, np.sort(near), np.zeros(0, np.uint64))])
    assert toxicity.distinct_rows(rows) in ([0, 1, 4], [0, 1, 3, 4])


# --------------------------------------------------------------------------- top-k
def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.3, 8), 2)], 0) for i in range(600)]
    rows += [(600, None, 0), (601, [0.1, None, 0.2], 0), (602, [float("nan")] * 8, 0), (603, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (604, [0.5] * 5, 0), (605, [], 0), (606, rows[5][1], 0)]
    rows += [rows[5], rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(5)
    vectors = quantised(df)
    keep = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            keep[i] = [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (8 - len(v))
    want = []
    for q in (i for i in keep if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(keep[q], v, strict=True)), i) for i, v in keep.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for c, b in ((16_384, 2048), (100, 3)):
        got = top_k(vectors, F.col("id") % 50 == 0, 5, candidates=c, queries=b)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_stops_early():
    rng = np.random.default_rng(4)
    matrix = rng.normal(0, 1, (5000, 4))
    block = Block(np.arange(5000), matrix)
    for q in range(0, 5000, 500):
        best = block.top(matrix[q], q, 5)
        want = sorted(((-float(matrix[i] @ matrix[q]), i) for i in range(5000) if i != q))[:5]
        assert [i for _, i in best] == [i for _, i in want]
    assert block.scored < 0.5 * 10 * 5000


def test_top_k_edges(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(quantised(one), F.lit(True)).count() == 0
    assert top_k(quantised(one.limit(0)), F.lit(True)).count() == 0
    big = spark.createDataFrame([(0, [1e12, 1.0]), (50, [1e12, 2.0]), (7, [1e12, 3.0])], "vec_id long, embedding array<double>")
    got = top_k(quantised(big), F.col("id") == 50, 5, candidates=2)
    assert [r.vec_id for r in got.limit(0).collect()] == []
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in top_k(quantised(ties), F.col("id") == 0, 3).orderBy("rank").collect()] == [1, 2, 3]
