import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from tests_support import toxic_words
from tokenizers import Tokenizer

import corpus_pipeline
from sparkchirp.llm import checks, queries
from sparkchirp.llm.common import ALNUM, Words, materialise
from sparkchirp.plans import shipping

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(map(str, frame.astype(str).itertuples(index=False)))


@pytest.mark.parametrize("name", [*queries.SQL, *checks.SQL])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    query, sql = (queries.QUERIES | checks.QUERIES)[name], (queries.SQL | checks.SQL)[name]
    assert rows(query(spark, SF).toPandas()) == rows(con.execute(sql).fetchdf())


def test_ten_queries_are_registered():
    import __spark_entry__ as entry

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert {*queries.QUERIES, *checks.QUERIES, "pipeline"} <= set(entry.queries()) and set(checks.QUERIES) == set(checks.SQL) <= set(entry.oracle_sql())


def repeated(texts, width=35):
    """Which words of each text are covered by a window that starts anywhere else too."""
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[p : p + width]) for w in words for p in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        out.append([x for x, g in zip(w, gone, strict=True) if not g] if any(gone) else None)
    return out


def near_classes(texts, least=0.8):
    """The number of the first text that links of equal texts or similar shingle sets reach, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9):
                a, b = root[i], root[j]
                if a != b:
                    root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_pipeline_stages(spark):
    """Each stage against a brute-force version of what it must do to its own input."""
    from sparkchirp.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = materialise(stage(spark, docs, SF), "test")
        got = out.collect()
        if name == "packing":
            tk = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
            ids = {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in before.items()}
            pieces = defaultdict(list)
            for r in got:
                assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
                pieces[r.doc_id].append((r.start, r.length))
            assert set(pieces) == set(ids)
            for i, x in pieces.items():
                x.sort()
                assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) == len(ids[i])
            place = sorted((r.sequence_id, r.offset, r.length) for r in got)
            at = 0
            for s, o, n in place:
                assert s * 2048 + o == at and o + n <= 2048
                at += n
        else:
            assert out.columns == columns
            after = {r.doc_id: r.text for r in got}
            assert len(after) == len(got) and set(after) <= set(before)
            keys, texts = sorted(before), [before[i] for i in sorted(before)]
            if name == "toxicity":
                model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.col("toxic"))
                weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
                for i, t in before.items():
                    w = Words(pa.array([t or ""]), ALNUM)
                    eta = sum(weight.get(h, 0.0) for h in set(w.hashes(lower=True).tolist()))
                    p = 1 - 1 / (1 + math.exp(eta - model.thresholds[0]))
                    assert abs(p - 0.5) < 1e-9 or (i in after) == (p < 0.5)
                gone = [before[i] for i in before if i not in after]
                assert sum(toxic_words(t) == 0 for t in gone) <= 0.3 * len(gone) + 1
            if name == "exact dedup":
                first = {}
                for i in keys:
                    first.setdefault(before[i] or "", i)
                assert after == {i: before[i] for i in first.values()}
            if name == "near-duplicate dedup":
                root = near_classes(texts)
                assert after == {i: before[i] for k, i in enumerate(keys) if root[k] == k}
            if name == "substring dedup":
                for i, left in zip(keys, repeated(texts), strict=True):
                    assert after[i] == (before[i] or "" if left is None else b" ".join(left).decode())
        sizes.append(len(got))
        docs = out
    assert sizes[0] > sizes[2] >= sizes[3] == sizes[4]


def test_pipeline_stages_with_odd_tables(spark):
    """Null and empty texts, null ids and sources, ties, repeated rows, clashing names, a very long text, empty tables."""
    long = " ".join(f"word{i * 7919 % 50_021}" for i in range(60_000))
    rows = [(1, None, "en", "a", 0, "k"), (2, "", "en", None, 0, "k"), (2, "", "en", None, 0, "k"), (None, "one two three", None, "a", 13, "l"), (None, None, None, None, None, None), (5, long, "en", "b", len(long), "m")]
    rows += [(6, long + " end", "en", "b", len(long) + 4, "m"), (7, "x", "en", "a", 1, "n"), (8, "x", "de", "a", 1, "n")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema).limit(0), spark.createDataFrame([], schema)):
        count = table.count()
        for name, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, table, SF), "odd")
            if name == "packing":
                assert (out.count() > 0) == (count > 0)
            else:
                assert out.columns == table.columns
                left = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
                ids = [i for null, i in left if not null]
                if count and name == "exact dedup":  # null is empty: of 1, 2, 2 and a null id one stays, of 7 and 8 one
                    assert ids == [1, 5, 6, 7] and len(left) == 5
                elif count and name == "near-duplicate dedup":
                    assert ids == [1, 5, 7] and len(left) == 4
                else:
                    assert len(left) == count


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "chain")
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_scratch_is_cleared(spark):
    kept, gone = materialise(spark.range(3), "kept"), materialise(spark.range(5), "gone")
    paths = shipping.scratch_paths(spark)
    assert shipping.clear_scratch(spark, keep=paths[:-1]) == 1 and shipping.scratch_paths(spark) == paths[:-1]
    assert kept.count() == 3 and not os.path.exists(paths[-1]) and gone is not None
