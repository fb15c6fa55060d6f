import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

P = pytest.importorskip("public_tokenizers")
from sparkchirp.llm import packing, pieces, records, tokens  # noqa: E402

MODEL, BYTES, WORDS = (P.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
FRESH = {path: Tokenizer.from_file(path) for path in (BYTES, WORDS)}  # the library as it is
ODD = st.text(alphabet=st.sampled_from(list(" \n\t▁aeiouéßthnABΣİ123.,'<>|s/世𝕏\x00\xa0 ́")), max_size=60)
TEXTS = ["", None, "Hello,  world.\n\nIt's  the <|endoftext|> end </s> ▁x", "a" * 3000, " ", "\n", "é 𝕏 世界 \x00", "the of and " * 2000, "the", "the"]


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_pieces_equal_the_library(text):
    import sentencepiece

    sp = test_pieces_equal_the_library.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=MODEL))
    m = pieces.model(MODEL)
    want = sp.encode(text, add_bos=True, add_eos=True)
    assert m.encode(text) == want and m.decode(want) == sp.decode(want)
    assert np.frombuffer(pieces.encode_column(MODEL, [text])[0], "<u4").tolist() == want


def test_decoding_any_ids_equals_the_library():
    import sentencepiece

    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.model(MODEL), random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        assert m.decode(ids) == sp.decode(ids), ids


def test_segments_equal_merging_the_best_pair():
    m, rng = pieces.model(MODEL), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("▁aeinrstlAB.=-") for _ in range(rng.randint(1, 24)))
        assert m.segment(text) == m.merge(text)


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_token_ids_equal_the_library(text):
    for path in (BYTES, WORDS):
        enc = tokens.encoder(path)
        want = FRESH[path].encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.packed([text])[0], enc.kind).tolist() == want


LETTERS = list(" \n\taeiouéßthnABΣİıſŉǰ123.,'<>|s/世𝕏\x00\xa0 ̣́̇“”’‘«»—-_ªºǅ가ㄱ가ΐΆЖйיִﬀ½²٣ไทยﷺ\u200b\u200d\ufeffक़ড়")
BITS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "</s>", "I've", "'LL", "VEDALİ,", "“İ.", "  ", "\n\n", "the", "Über", "ÇAĞRI.", "世界。", "a.b", "e.g.,"]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_of_odd_texts_equal_the_library(path):
    rng = random.Random(11)
    texts = ["".join(rng.choice(BITS) if rng.random() < 0.15 else rng.choice(LETTERS) for _ in range(rng.choice([1, 2, 3, 5, 8, 20]))) for _ in range(50_000)]
    texts += [f"{a}{chr(c)}{b}" for c in (*range(1, 0xD800), *range(0xE000, 0x11000)) for a, b in (("“", "."), ("a", ","))]
    enc = tokens.Encoder(path)
    want = [x.ids for x in FRESH[path].encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, enc.kind).tolist() for x in enc.packed(texts)]
    assert [t for t, w, g in zip(texts, want, got, strict=True) if w != g] == []


def test_long_unbroken_text_is_linear():
    m, begin = pieces.model(MODEL), time.process_time()
    text = "".join(random.Random(2).choice("aeinrstl") for _ in range(400_000))
    ids = m.encode(text)
    assert time.process_time() - begin < 20 and m.decode(ids) == text


def test_memory_bound_does_not_change_ids():
    enc = tokens.Encoder(WORDS)
    enc.memo.most = 5
    texts = [f"word{i} Again, and again{i % 3}." for i in range(50)]
    want = [x.ids for x in FRESH[WORDS].encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, enc.kind).tolist() for t in texts for x in enc.packed([t])] == want
    assert len(enc.memo.known) < 60


def test_round_trip_frame(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.id: r for r in pieces.round_trip(docs, MODEL, texts=True).collect()}
    m = pieces.model(MODEL)
    for i, t in enumerate(TEXTS):
        ids = m.encode(t or "")
        assert bytes(got[i].ids) == np.array(ids, "<u4").tobytes() and got[i].decoded == m.decode(ids)
    odd = spark.createDataFrame([(None, "the end", 1), (None, None, 2), (7, "of " * 60_000, 3)], "doc_id long, text string, id int")
    got_odd = pieces.round_trip(odd, MODEL, texts=True).collect()
    assert sorted((r.id is None, r.decoded) for r in got_odd) == [(False, "of " * 60_000), (True, ""), (True, "the end")]
    digest = pieces.round_trip(docs, MODEL).where("id = 2").first()
    assert digest.ids_sha256 == hashlib.sha256(bytes(got[2].ids)).hexdigest()
    assert pieces.round_trip(docs.limit(0), MODEL).count() == 0


def test_records(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(3)
    manifest = records.write_tokens(docs, BYTES, 2, str(tmp_path / "t"))
    got = sorted(records.read_tokens(manifest).collect(), key=lambda r: r.start)
    tk, at = FRESH[BYTES], 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    none = records.write_tokens(docs.limit(0), BYTES, 2, str(tmp_path / "none"))
    assert none.count() == 0 and records.read_tokens(none).count() == 0


def test_record_files_and_damage(tmp_path):
    path = str(tmp_path / "a.rec")
    w = records.RecordWriter(path, 2)
    data = [(i if i % 3 else None, np.arange(i, dtype="<u2").tobytes()) for i in range(20)]
    for key, ids in data:
        w.add(key, ids)
    w.close()
    reader = records.RecordReader(path)
    assert list(reader.records()) == data
    order = list(range(20))
    random.Random(0).shuffle(order)
    assert list(reader.records(order)) == [data[i] for i in order]
    raw = bytearray(open(path, "rb").read())
    (n,) = struct.unpack("<Q", raw[:8])
    assert len(records.frame(bytes(n))) == n + 16
    raw[int(reader.offsets[7]) + 14] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="damaged record 7"):
        list(reader.records())


def check_packing(got, ids, length):
    place = {}
    for r in got:
        assert 0 < r.length and r.offset + r.length <= length
        assert r.ids_crc32 == zlib.crc32(ids[r.id][r.start : r.start + r.length].astype("<u4").tobytes()) and r.doc_tokens == len(ids[r.id])
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for r in sorted((r for r in got if r.id == i), key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    sizes = []
    for s in sorted(place):
        at = 0
        for a, n in sorted(place[s]):
            assert a == at
            at += n
        sizes.append(at)
    assert sorted(place) == list(range(len(sizes))) and sizes[:-1] == [length] * (len(sizes) - 1)


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "of", "zebra", "x1"]) for _ in range(rng.choice([0, 3, 40, 900]))) or None, "big" if i % 3 else f"s{i % 4}", i) for i in range(120)]
    rows[7] = (7, "a b c", None, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, start int")
    table = packing.tokenise(docs, WORDS, 1)
    tk = FRESH[WORDS]
    ids = {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _, _ in rows}
    got = packing.pack(table, 128, 4).collect()
    check_packing(got, ids, 128)
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in got) == total
    aimed = packing.pack(table, 128, 4, {"big": 1.0, "s0": 1.0}, with_ids=True).collect()
    check_packing(aimed, ids, 128)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in aimed)
    assert packing.pack(packing.tokenise(docs.limit(0), WORDS, 1)).count() == 0


def round_robin(queues, span, weights, grain):
    """All tokens (row, place in the row) in the order in which deficit round robin sends them, window by window."""
    key = lambda s: "" if s is None else "s" + s
    out, share = [], {s: w / sum(weights.values()) for s, w in weights.items()}
    rest = {s: len(x) for s, x in queues.items() if s not in share}
    for part in (share, {s: n / sum(rest.values()) for s, n in rest.items()}):
        left, k = {s: list(queues[s]) for s in part if queues.get(s)}, 0
        sent = dict.fromkeys(left, 0)
        while any(left.values()):
            k += 1
            window = []
            for s in sorted(left, key=key):
                due = int(k * (span * part[s]) / grain) * grain - sent[s]
                window += left[s][:due]
                left[s] = left[s][due:]
                sent[s] += due
            out.append(window)
    return out


@pytest.mark.parametrize("grain", [1, 16])
def test_packing_is_deficit_round_robin(spark, grain):
    rng = random.Random(6)
    sizes = {"a": 60, "b": 40, "c": 30, None: 4, "tiny": 1}
    rows = [(s, n) for s, many in sizes.items() for n in [rng.choice([1, 5, 70, 300]) for _ in range(many)]]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "row long, source string, n long").repartition(5)
    queues = {}
    for i, (s, n) in enumerate(rows):
        queues.setdefault(s, []).extend((i, p) for p in range(n))
    tokens = {s: len(x) for s, x in queues.items()}
    for targets, temper, weights in (
        (None, 1.0, {s: float(n) for s, n in tokens.items()}),
        (None, 0.5, {s: float(n) ** 0.5 for s, n in tokens.items()}),
        ({"a": 1.0, "b": 3.0, "nothing": 1.0}, 1.0, {"a": 1.0, "b": 3.0, "nothing": 1.0}),
    ):
        if targets:  # a source that is not there takes no share
            weights = {s: w for s, w in weights.items() if s in tokens}
        want = round_robin(queues, 256, weights, grain)
        got = packing.schedule(table, 64, 4, targets, temper, grain).collect()
        place = {}
        for r in got:
            for k in range(r.len):
                assert place.setdefault(r.at + k, (r.row, r.start + k)) == (r.row, r.start + k)
        assert [place[i] for i in range(len(place))] == [t for w in want for t in w]
        # while all queues last, each window holds each source's share to a grain
        source = {i: s for i, (s, _) in enumerate(rows)}
        lasting = min(tokens[s] * sum(weights.values()) / w / 256 for s, w in weights.items())
        for window in want[: int(lasting)]:
            for s, w in weights.items():
                assert abs(sum(source[i] == s for i, _ in window) - 256 * w / sum(weights.values())) < grain + 1e-6


def test_packing_null_ids_and_sources(spark):
    docs = spark.createDataFrame([(None, "a b", None, 1), (None, None, None, 2), (3, "", "s", 3)], "doc_id long, text string, source string, row int")
    got = packing.pack(packing.tokenise(docs, WORDS, 1), 8, 1).collect()
    assert sorted((r.id is None, r.length) for r in got) == [(False, 1), (True, 1), (True, 3)]


def test_packing_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text", "s")] * 5, "doc_id long, text string, source string")
    got = packing.pack(packing.tokenise(docs, WORDS, 1), 8, 1).collect()
    assert sum(r.length for r in got) == 15
