"""Pieces shared by the corpus operators: scratch tables, sizing, word arrays and token caches."""

from __future__ import annotations

import contextlib
import ctypes
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import shared_path as new_path

U64 = np.uint64


# --------------------------------------------------------------------------- scratch tables
def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives executors.

    The table stays until ``clear_scratch`` of ``plans.shipping`` is called.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --------------------------------------------------------------------------- sizing
def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of text) of a frame: two numbers reach the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return int(row.n), int(row.b or 0)


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` units ``total`` units need."""
    return max(least, math.ceil(total / each))


MOST_PARTS = 1 << 15  # tasks of a stage; beyond, a task goes through more groups or sorts more rows, both with bounded memory


def fan_out(spark: SparkSession, total_bytes: int, each: int = 16 << 20) -> int:
    """Partitions for a shuffle of so many bytes; never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, pieces(total_bytes, each)))


# --------------------------------------------------------------------------- word arrays
_SPACE = np.ones(256, np.bool_)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False  # True: part of a word
#: As above for words of letters, digits and characters beyond ASCII alone.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, dtype=U64)


_BYTE = _table(20240607)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        full = np.full(size, U64(base & (2**64 - 1)), U64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if size <= 1 << 24:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, array-wise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a string column as flat arrays.

    ``data`` the UTF-8 bytes of all texts, ``start``/``end`` byte positions of every word,
    ``first`` index of each document's first word (one more entry closes the last document).
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, part_of_word: np.ndarray = _SPACE):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if column.null_count:
            column = column.fill_null("")
        column = column.cast(pa.large_string())
        n = len(column)
        if n:
            offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
        else:
            offsets = np.zeros(1, np.int64)
        raw = column.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offset = offsets - offsets[0]
        inside = part_of_word[self.data]
        before = np.empty(len(inside), np.bool_)
        before[1:] = inside[:-1]
        marks = self.offset[:-1][self.offset[:-1] < len(inside)]
        before[marks] = False
        after = np.empty(len(inside), np.bool_)
        after[:-1] = inside[1:]
        ends = self.offset[1:][self.offset[1:] > 0] - 1
        after[ends] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offset)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of every word; with ``lower``, of the word with A-Z lower-cased."""
        if not len(self.start):
            return np.zeros(0, U64)
        data = self.data
        table = _BYTE
        if lower:
            table = _BYTE.copy()
            table[65:91] = _BYTE[97:123]
        out = np.empty(len(self.start), U64)
        # blocks of documents keep the 64-bit temporaries small
        step = 1 << 18
        doc, last = 0, len(self.offset) - 1
        while doc < last:
            to = int(np.searchsorted(self.offset, self.offset[doc] + step, "right")) - 1
            to = min(last, max(doc + 1, to))
            a, b = int(self.offset[doc]), int(self.offset[to])
            i, j = int(self.first[doc]), int(self.first[to])
            if j > i:
                n = b - a
                sums = np.empty(n + 1, U64)
                sums[0] = 0
                np.cumsum(table[data[a:b]] * powers(_BASE, n), out=sums[1:])
                s, e = self.start[i:j] - a, self.end[i:j] - a
                out[i:j] = (sums[e] - sums[s]) * powers(_INV, n)[s]
                out[i:j] += (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
            doc = to
        return mix(out)

    def doc_of(self) -> np.ndarray:
        """Document index of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


_GRAM = 0xC2B2AE3D27D4EB4F | 1
_GRAM_INV = pow(_GRAM, -1, 1 << 64)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries; run i starts at entry i (document ends are the caller's)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = np.empty(len(hashes) + 1, U64)
    sums[0] = 0
    np.cumsum(hashes * powers(_GRAM, len(hashes)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(_GRAM_INV, n))


def gram_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Boolean per word: does a run of ``width`` words of one document start here?"""
    total = int(first[-1])
    ok = np.ones(total, np.bool_)
    for k in range(1, width):
        at = first[1:] - k
        ok[at[at >= first[:-1]]] = False
    return ok


def lengths_to_offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def binary_column(blob: bytes, offsets: np.ndarray) -> pa.Array:
    """A binary column over one buffer."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(blob)]
    ).cast(pa.binary())


# --------------------------------------------------------------------------- memory of token ids
class ChunkMemo:
    """Packed token ids of text chunks, remembered within a bound.

    ``encode`` gives the packed ids (numpy kind ``kind``) of a list of chunks; ``reduce`` may name the parts of
    a chunk whose ids, one after the other, are those of the chunk.
    """

    def __init__(self, encode, kind: str, reduce=None, most: int = 1_200_000):
        self.encode, self.kind, self.reduce, self.most = encode, kind, reduce or (lambda c: (c,)), most
        self.known: dict[str, bytes] = {"": b""}

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of distinct chunks."""
        known = self.known
        out = list(map(known.get, chunks))
        if None not in out:
            return out
        if len(known) > self.most:
            known.clear()
            known[""] = b""
        miss = [i for i, x in enumerate(out) if x is None]
        parts = [self.reduce(chunks[i]) for i in miss]
        new = list({p for ps in parts for p in ps if p not in known})
        if new:
            known.update(zip(new, self.encode(new), strict=True))
        for i, ps in zip(miss, parts, strict=True):
            out[i] = known[chunks[i]] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
        return out

    def packed(self, cut: list[str]) -> list[bytes]:
        """Packed ids of texts that are cut into chunks by NUL characters."""
        lists = pc.split_pattern(pa.array(cut, pa.large_string()), "\x00")
        return self.packed_chunks(lists.values, np.asarray(lists.offsets))

    def packed_chunks(self, chunks: pa.Array, first: np.ndarray) -> list[bytes]:
        """Packed ids of texts: text i is the chunks first[i] to first[i + 1] - 1."""
        coded = chunks.dictionary_encode()
        values = pa.array(self.lookup(coded.dictionary.to_pylist()), pa.large_binary())
        out: list[bytes] = []
        a, texts = 0, len(first) - 1
        while a < texts:  # a million chunks at a time
            b = min(texts, max(a + 1, int(np.searchsorted(first, first[a] + (1 << 20), "right")) - 1))
            part = values.take(coded.indices[int(first[a]) : int(first[b])])
            ends = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1) if len(part) else np.zeros(1, np.int64)
            data = memoryview(part.buffers()[2] or b"") if len(part) else memoryview(b"")
            at = ends[first[a : b + 1] - first[a]].tolist()
            out += [bytes(data[p:q]) for p, q in zip(at[:-1], at[1:], strict=True)]
            a = b
        return out

    def packed_lists(self, chunks: list[list[str]]) -> list[bytes]:
        """Packed ids of texts given as lists of chunks."""
        distinct = list({c for x in chunks for c in x})
        look = dict(zip(distinct, self.lookup(distinct), strict=True))
        return [b"".join([look[c] for c in x]) for x in chunks]


def text_blocks(texts: list[str], most: int = 1 << 23):
    """Consecutive slices of about ``most`` characters, one text at least."""
    begin = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def row_slices(column: pa.Array, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes of a string column, one row at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    out, a = [], 0
    while a < len(ends):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        out.append((a, b))
        a = b
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends Python at most 8 MB of rows at a time (where its own bound is still the default)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, str(8 << 20))
    return df


def tidy() -> None:
    """Give memory that Python has freed back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(work):
    """A function on Arrow batches that starts and ends with ``tidy``."""

    def wrapped(batches):
        tidy()
        yield from work(batches)
        tidy()

    return wrapped


def tidied_group(work):
    """A function on the Arrow table of a group (or two) that ends with ``tidy``."""

    def one(table):
        try:
            return work(table)
        finally:
            tidy()

    def two(table, other):
        try:
            return work(table, other)
        finally:
            tidy()

    return two if work.__code__.co_argcount == 2 else one


def safe_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name = "_" + name
    return name
