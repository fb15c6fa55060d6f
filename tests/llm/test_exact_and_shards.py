import hashlib
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from sparkchirp.llm.exact_dedup import duplicate_groups, exact_dedup
from sparkchirp.llm.sharding import SlotMap, shard, slot_weights, with_slots

SCHEMA = "doc_id long, text string, keep_id string, row string, kept string, `a.b` int"
ROWS = [
    (1, "x", "a", "r", "k", 1), (2, "x", "b", "r", "k", 2), (3, None, "c", "r", "k", 3), (4, "", "d", "r", "k", 4), (5, "y " * 5000, "e", "r", "k", 5),
    (7, "x", "f", "r", "k", 6), (7, "x", "f", "r", "k", 6), (None, "x", "g", "r", "k", 7), (None, "z", "h", "r", "k", 8), (None, "z", "i", "r", "k", 9),
]


def test_groups_for_both_rules_and_hot_sizes(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for hot in (1, 2, 100):
        for keep, best in (("smallest", 1), ("largest", 7)):
            got = duplicate_groups(docs, keep=keep, hot=hot).collect()
            assert len(got) == len(ROWS)
            x = [r for r in got if r.text_sha256 == hashlib.sha256(b"x").hexdigest()]
            assert {(r.keep_id, r.group_size) for r in x} == {(best, 5)} and sum(r.kept for r in x) == 1
            assert [r.id for r in x if r.kept] == [best]
            empty = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
            assert sorted(r.id for r in empty) == [3, 4] and sum(r.kept for r in empty) == 1
            z = [r for r in got if r.text_sha256 == hashlib.sha256(b"z").hexdigest()]
            assert len(z) == 2 and sum(r.kept for r in z) == 1 and z[0].keep_id is None


def test_dedup_keeps_columns_and_nulls(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for hot in (1, 100):
        got = duplicate_groups(docs, hot=hot, heads=True)
        assert got.where("kept").count() == 4
    out = exact_dedup(docs)
    assert out.columns == docs.columns and {(r.doc_id, r.text and r.text[:2]) for r in out.collect()} == {(1, "x"), (3, None), (5, "y "), (None, "z")}
    folded = exact_dedup(docs, normalise=lambda c: F.substring(c, 1, 0))
    assert folded.count() == 1 and folded.columns == docs.columns


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert duplicate_groups(none).count() == 0 and exact_dedup(none).columns == none.columns
    assert shard(none, 3).count() == 0


def test_hot_group_is_spread_and_whole(spark):
    docs = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = duplicate_groups(docs, keep="largest", carry=[]).groupBy("group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1000, True, 1), (1000, False, 999), (1, True, 2000)}


def test_shards(spark):
    rows = [(i, "w" * (i * 37 % 501) if i % 9 else None) for i in range(2000)] + [(5, "w"), (None, "q"), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard(docs, 7, slots=256).collect()
    assert len(got) == len(rows)
    for s in range(7):
        assert sorted(r.place for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    load = [sum(r["size"] for r in got if r.shard == s) for s in range(7)]
    assert max(load) - min(load) < 0.02 * sum(load) / 7
    assert {(r.id, r["size"], r.text_crc32) for r in got} == {(i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t in rows}
    assert len({(r.vslot, r.shard) for r in got}) == len({r.vslot for r in got})


def test_shards_equal_brute_force(spark):
    """Slots, map and places computed again; hot copies, clashing names, a very long text."""
    rows = [(i, "same" if i % 3 else "t" * (i % 77), i, "x") for i in range(600)] + [(None, None, 1, "y"), (9000, "z " * 400_000, 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, vslot string").repartition(3)
    got = shard(docs, 5, slots=64).collect()

    def slot(i, crc):
        h = 42
        for x in (i, crc):
            if x is not None:
                h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return (h - (1 << 64) if h >> 63 else h) % 64

    records = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows]
    held = {}
    for r in records:
        held.setdefault(slot(r[0], r[2]), []).append(r)
    load, filled, want = [0] * 5, [0] * 5, {}
    weights = {v: sum(r[1] for r in x) for v, x in held.items()}
    for v in sorted(range(64), key=lambda v: (-weights.get(v, 0), v)):
        s = min(range(5), key=lambda k: (load[k], k))
        load[s] += weights.get(v, 0)
        want[v] = s
    place = {}
    for v in range(64):
        for r in sorted(held.get(v, []), key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
            place[r[0]] = (r[1], r[2], v, want[v], filled[want[v]])
            filled[want[v]] += 1
    assert {r.id: (r["size"], r.text_crc32, r.vslot, r.shard, r.place) for r in got} == place and len(got) == len(rows)


def test_growing_moves_slots_only_to_the_new_shard(spark, tmp_path):
    docs = spark.range(0, 3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int")).alias("text"))
    weights, rows = slot_weights(with_slots(docs, slots=512), 512)
    assert sum(rows) == 3000
    first = SlotMap.balanced(weights, 8)
    second = first.grown(weights)
    assert (second.version, second.shards) == (2, 9)
    assert all(b in (a, 8) for a, b in zip(first.shard_of, second.shard_of, strict=True))
    load = [sum(w for w, s in zip(weights, second.shard_of, strict=True) if s == k) for k in range(9)]
    assert max(load) - min(load) < 0.05 * sum(load) / 9
    for m in (first, second):
        stored = m.store(spark, str(tmp_path / "map")).orderBy("vslot").collect()
        assert tuple(r.shard for r in stored) == m.shard_of


def test_content_is_shuffled_once(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plan = duplicate_groups(docs, hot=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(prefix" in plan
