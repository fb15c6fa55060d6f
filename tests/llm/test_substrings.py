import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkchirp.llm import substrings
from sparkchirp.llm.automaton import SuffixAutomaton, spans
from sparkchirp.llm.common import Words, gram_starts, grams


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append((len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(14)]
    texts = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([0, 3, 30, 80]))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[: rng.randint(5, 14)]
        if i % 10 == 1 and texts:
            w = texts[-1].split() if texts[-1] else w
            if w:
                w[rng.randrange(len(w))] = "edit"
        texts.append(" \n".join(w) if i % 2 else "\t".join(w))
    return texts + [None, "", "to " * 40, "x y " * 30, texts[5], texts[5], "nbsp\xa0inside word " * 3]


def test_frame_equals_brute_force(spark, monkeypatch):
    texts = corpus(1)
    docs = spark.createDataFrame([(i, t, "z", 0) for i, t in enumerate(texts)], "doc_id long, text string, kept string, g int").repartition(4)
    for group in (300, 1 << 20):
        monkeypatch.setattr(substrings, "GROUP_BYTES", group)
        monkeypatch.setattr(substrings, "BUCKET_BYTES", 2 * group)
        monkeypatch.setattr(substrings, "SHARD_BYTES", group)
        got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, width=6).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 6)
    digest = {r.row.doc_id: r.kept for r in substrings.remove_repeats(docs, width=6, digest=True).collect()}
    assert digest[0] == hashlib.sha256(brute(texts, 6)[0][2].encode()).hexdigest()
    out = substrings.without_repeats(docs, width=6)
    assert out.columns == docs.columns and out.count() == len(texts)


def test_hot_anchors_and_colliding_keys(spark, monkeypatch):
    """Anchors of few or many places, and keys that tell nothing apart: the automata alone must decide."""
    texts = corpus(2, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = substrings.Anchored

    class Folded(real):
        def __init__(self, column, width):
            super().__init__(column, width)
            self.key = self.key % np.uint64(3)

        def windows(self, which):
            start, key = super().windows(which)
            return start, key % np.uint64(3)

    for hot, kind in ((0, real), (2, real), (1 << 30, Folded), (2, Folded)):
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings, "GROUP_BYTES", 500)
        monkeypatch.setattr(substrings, "Anchored", kind)
        got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, width=6).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts, 6)


def test_stretches_cover_each_window_once():
    texts = corpus(3, 80)
    found = substrings.Anchored(pa.array(texts, pa.string()), 6)
    start, key = found.windows(np.arange(len(found.begin)))
    w = found.words
    want = [w.first[d] + i for d in range(len(texts)) for i in range(w.first[d + 1] - w.first[d] - 5)]
    assert start.tolist() == want and len(key) == len(want)
    anchor = {}
    for i, (a, b) in enumerate(zip(found.begin, found.last, strict=True)):
        for s in range(a, b + 1):  # equal windows have equal anchors
            assert anchor.setdefault(tuple(w.word(k) for k in range(s, s + 6)), found.key[i]) == found.key[i]


def test_very_long_text_and_clashing_names(spark):
    one = [f"w{i * 7919 % 100_003}" for i in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(one), 1, "x", 5), (2, "p q " + " ".join(one[500:560]), 2, "y", 6)], "doc_id long, text string, shard int, words string, n_words int")
    got = {r.row.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert (got[2].n_words, got[2].n_removed, got[2].kept, got[2].row.words) == (62, 60, "p q", "y")
    assert got[1].n_words == 200_000 and got[1].n_removed == brute([" ".join(one), " ".join(one[500:560])], 35)[0][1]


def test_empty_and_short(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert {(r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect()} == {(1, 0, 0, ""), (2, 0, 0, ""), (3, 2, 0, "a b")}
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_untouched_texts_stay_as_they_were(spark):
    docs = spark.createDataFrame([(1, " a\n b ", 6), (2, "c " * 12, 24), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in substrings.without_repeats(docs, width=4).collect()}
    assert got == {1: (" a\n b ", 6), 2: ("", 0), 3: ("", 0)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 2), max_size=20), st.integers(1, 4))
def test_matching_statistics(sequences, query, times):
    a = SuffixAutomaton()
    for s in sequences:
        a.add(s)
    a.finish()
    for i, n in enumerate(a.shared(query, times)):
        longest = 0
        for k in range(1, i + 2):
            x = tuple(query[i - k + 1 : i + 1])
            if sum(x == tuple(s[j : j + k]) for s in sequences for j in range(len(s) - k + 1)) >= times:
                longest = k
        assert n == longest


@given(st.lists(st.integers(0, 6), max_size=30), st.integers(1, 4))
def test_spans_are_the_cover_of_the_matches(statistics, width):
    statistics = [min(n, i + 1) for i, n in enumerate(statistics)]
    flags = [any(n >= width and i - n < p <= i for i, n in enumerate(statistics)) for p in range(len(statistics))]
    got = spans(statistics, width)
    assert [any(a <= p < b for a, b in got) for p in range(len(statistics))] == flags


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab\xa0é\x1c", max_size=12), max_size=6))
def test_words(texts):
    w = Words(pa.array(texts, pa.string()))
    want = [x.encode().split() for x in texts]
    assert [w.word(i) for i in range(len(w))] == [x for v in want for x in v]
    assert np.diff(w.first).tolist() == [len(v) for v in want]
    h = w.hashes()
    for i in range(len(w)):
        for j in range(i):
            assert (h[i] == h[j]) == (w.word(i) == w.word(j))
    ok = gram_starts(w.first, 2)
    assert ok.sum() == sum(max(0, len(v) - 1) for v in want)
    assert len(grams(h, 2)) == max(0, len(h) - 1)
