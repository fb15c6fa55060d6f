"""Counting keys of all documents without a row for each key.

Documents are dealt by a hash into groups of bounded text size.  A group sends each bucket of the key space one
sorted array of its distinct keys with their counts (so a key that a third of all documents hold is sent once a
group), the bucket adds up what the groups sent and answers each of them in the order of its keys.

Inside a bucket a key is known by its whole 64 bits or by its lowest 40.  A bucket stands for a fixed amount of text,
so that two of its keys share 40 bits at the same rate (about 2 in a million) whatever the size of the input: enough
where a count only says what to look at again.  Whole keys are dealt to buckets by range, so that those of a message
lie close together and take few bits.
Groups and buckets are dealt to tasks by number, so that no task gets many of them by chance; a task goes through
its groups or buckets one after the other.  A message holds at least one key, so there are never more of them than
distinct keys in groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MOST_PARTS, U64, pieces, small_batches, tidied

LOW = 40
_MASK = U64((1 << LOW) - 1)
_HIGH = 1 << (LOW - 32)
MESSAGE = "bucket int, g int, usual int, keys array<binary>, counts array<binary>"
ANSWER = "g int, bucket int, totals array<binary>"


@dataclass
class Dealt:
    """``rows`` (g, h, text, row and what else was asked for), partitioned by group; numbers of groups and buckets; bytes."""

    rows: DataFrame
    groups: int
    buckets: int
    size: int

    def by_bucket(self, messages: DataFrame, column: str = "bucket") -> DataFrame:
        return messages.repartitionById(min(self.buckets, MOST_PARTS), column)

    def to_groups(self, answers: DataFrame) -> DataFrame:
        """Answers dealt like the rows."""
        return answers.repartitionById(min(self.groups, MOST_PARTS), "g")

    def by_group(self, answers: DataFrame):
        """Answers beside the rows: ready for a cogrouped function."""
        return self.rows.groupBy("g").cogroup(self.to_groups(answers).groupBy("g"))


def zipped(batches):
    """The batches with their texts compressed one by one, each behind its size."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        data = pa.array([len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in texts], pa.binary())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", data)


def unzipped(table: pa.Table) -> pa.Table:
    """The table with its texts as they were before ``zipped``."""
    codec = pa.Codec("zstd")
    texts = [codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in table.column("text").to_pylist()]
    return table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.large_binary()).view(pa.large_string()))


def deal(docs: DataFrame, id_col: str, text_col: str, row: Column, group_bytes: int, bucket_bytes: int, apart: Column | None = None, zip_texts: bool = False, **more: Column) -> Dealt:
    """Deal documents into groups by a hash of id and text; ``h`` orders the rows of a group the same way each time.
    Rows that ``apart`` holds for lie in groups of their own.  With ``zip_texts`` the texts are ``zipped``."""
    rows = docs.select(
        F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("h"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        row.alias("row"),
        (F.lit(False) if apart is None else F.coalesce(apart, F.lit(False))).alias("apart"),
        *[c.alias(n) for n, c in more.items()],
    )
    cost = F.octet_length("text").cast("long") + 64
    size, other = rows.agg(F.coalesce(F.sum(cost), F.lit(0)), F.coalesce(F.sum(F.when(F.col("apart"), cost)), F.lit(0))).first()
    first, second = pieces(size - other, group_bytes), pieces(other, group_bytes)
    group = F.when(F.col("apart"), first + F.pmod("h", F.lit(second))).otherwise(F.pmod("h", F.lit(first))).cast("int")
    groups = first + (second if other else 0)
    rows = rows.select(group.alias("g"), *[c for c in rows.columns if c != "apart"])
    if zip_texts:
        kinds = [T.StructField(f.name, T.BinaryType()) if f.name == "text" else f for f in rows.schema]
        rows = small_batches(rows).mapInArrow(tidied(zipped), T.StructType(kinds))
    rows = rows.repartitionById(min(groups, MOST_PARTS), "g")
    return Dealt(rows, groups, pieces(size, bucket_bytes), size)


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a group in the order of ``h``."""
    return table.take(pa.array(np.argsort(np.asarray(table.column("h")), kind="stable")))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


# --------------------------------------------------------------------------- packing
def pack_keys(keys: np.ndarray, whole: bool) -> bytes:
    """Sorted keys: whole, or the lowest 40 bits as 32 bits and, for the 8 above, a bitmap with a one for each key after
    as many zeros as these 8 bits say.

    Whole keys are taken from the first one on and cut where the parts above have about as many values as there are keys:
    their number, the first key, the bits of the lower parts, these parts in whole bytes and then single bits, and a
    bitmap as above for the parts above.
    """
    if whole:
        n = len(keys)
        if n < 2:
            return keys.astype("<u8").tobytes()
        off = keys - keys[0]
        low = max(0, (int(off[-1]) // n).bit_length() - 1)
        high = (off >> U64(low)).astype(np.int64)
        bits = np.zeros(n + int(high[-1]), np.uint8)
        bits[high + np.arange(n)] = 1
        parts = off.astype("<u8").view(np.uint8).reshape(n, 8)
        data = [np.array([n], "<u4").tobytes(), keys[:1].astype("<u8").tobytes(), bytes([low])]
        data += [parts[:, i].tobytes() for i in range(low // 8)]
        if low % 8:
            data.append(np.packbits(np.unpackbits(parts[:, low // 8, None], axis=1)[:, 8 - low % 8 :]).tobytes())
        return b"".join(data) + np.packbits(bits).tobytes()
    bits = np.zeros(len(keys) + _HIGH, np.uint8)
    bits[(keys >> U64(32)).astype(np.int64) + np.arange(len(keys))] = 1
    return (keys & U64(0xFFFFFFFF)).astype("<u4").tobytes() + np.packbits(bits).tobytes()


def unpack_keys(data: bytes, whole: bool) -> np.ndarray:
    if whole:
        if len(data) <= 8:
            return np.frombuffer(data, "<u8")
        n, first, low, at = int.from_bytes(data[:4], "little"), np.frombuffer(data, "<u8", 1, 4)[0], data[12], 13
        parts = np.zeros((n, 8), np.uint8)
        for i in range(low // 8):
            parts[:, i] = np.frombuffer(data, np.uint8, n, at)
            at += n
        if rest := low % 8:
            size = (n * rest + 7) // 8
            some = np.zeros((n, 8), np.uint8)
            some[:, 8 - rest :] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * rest).reshape(n, rest)
            parts[:, low // 8] = np.packbits(some, axis=1)[:, 0]
            at += size
        high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=at))) - np.arange(n)
        return (parts.view("<u8")[:, 0] | high.astype(U64) << U64(low)) + first
    n = (8 * len(data) - _HIGH) // 33  # 32 bits and one bit a key, whole bytes
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=4 * n), count=n + _HIGH)
    high = np.flatnonzero(bits)
    return np.frombuffer(data, "<u4", n).astype(U64) | ((high - np.arange(n)).astype(U64) << U64(32))


def pack_counts(values: np.ndarray, usual) -> bytes:
    """A bit for each count that is not the ``usual`` one; these in a byte each, 255 for those that follow in eight bytes."""
    other = values != usual
    if not other.any():
        return b""
    values = values[other]
    large = values >= 255
    return np.packbits(other).tobytes() + np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int, usual) -> np.ndarray:
    """The ``n`` counts of ``pack_counts``."""
    out = np.full(n, usual, np.int64)
    if data:
        other = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8), count=n))
        at = (n + 7) // 8
        values = np.frombuffer(data, np.uint8, len(other), at).astype(np.int64)
        values[values == 255] = np.frombuffer(data, "<u8", offset=at + len(other))
        out[other] = values
    return out


class Counted:
    """Distinct keys of a group and their counts there, by bucket and then key."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, buckets: int, whole: bool = False):
        if whole:
            self.order = np.argsort(keys)
            self.keys = keys[self.order]
            bucket = (self.keys >> U64(32)) * U64(buckets) >> U64(32)
        else:
            bucket = (keys >> U64(LOW)) % U64(buckets)
            code = bucket << U64(LOW) | keys & _MASK
            self.order = np.argsort(code)
            self.keys = code[self.order] & _MASK
            bucket = bucket[self.order]
        self.whole, self.counts = whole, counts[self.order]
        first = runs(bucket)
        ends = np.append(first[1:], len(bucket))[: len(first)]
        self.bounds = dict(zip(bucket[first].tolist(), zip(first.tolist(), ends.tolist(), strict=True), strict=True))

    def part(self, bucket: int) -> slice:
        return slice(*self.bounds.get(bucket, (0, 0)))


def messages(sets: list[Counted], g: int, usual: int) -> pa.Table:
    """What a group sends: a row for each bucket that any of its sets has keys in; most counts are ``usual``."""
    ids = sorted(set().union(*(s.bounds for s in sets)))
    keys = [[pack_keys(s.keys[s.part(b)], s.whole) for s in sets] for b in ids]
    counts = [[pack_counts(s.counts[s.part(b)], usual) for s in sets] for b in ids]
    lists = pa.list_(pa.binary())
    return pa.table([pa.array(ids, pa.int32()), pa.array([g] * len(ids), pa.int32()), pa.array([usual] * len(ids), pa.int32()), pa.array(keys, lists), pa.array(counts, lists)], names=["bucket", "g", "usual", "keys", "counts"])


class Summed:
    """What a bucket was sent, added up: distinct ``keys`` and ``sums`` of every set, and the answer to each message."""

    def __init__(self, table: pa.Table, whole: list[bool]):
        self.keys, self.sums, self.replies = [], [], [[] for _ in range(table.num_rows)]
        keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        usual = table.column("usual").to_pylist()
        for m, w in enumerate(whole):
            sent = [unpack_keys(x[m], w) for x in keys]
            size = [len(x) for x in sent]
            flat = np.concatenate(sent)
            own = np.concatenate([unpack_counts(x[m], n, u) for x, n, u in zip(counts, size, usual, strict=True)])
            at = np.argsort(flat, kind="stable")
            flat = flat[at]
            first = runs(flat)
            sums = np.add.reduceat(own[at], first) if len(first) else np.zeros(0, np.int64)
            total = np.empty(len(at), np.int64)
            total[at] = np.repeat(sums, np.diff(np.append(first, len(at)))[: len(first)])
            self.keys.append(flat[first])
            self.sums.append(sums)
            end = 0
            for reply, n in zip(self.replies, size, strict=True):
                reply.append(pack_counts(total[end : end + n], own[end : end + n]))
                end += n

    def answers(self, table: pa.Table) -> pa.Table:
        return pa.table([table.column("g"), table.column("bucket"), pa.array(self.replies, pa.list_(pa.binary()))], names=["g", "bucket", "totals"])


def totals(sets: list[Counted], answers) -> list[np.ndarray]:
    """Counts over all groups in the order in which the sets' keys were given; ``answers`` gives (bucket, totals)."""
    out = [s.counts.copy() for s in sets]
    for bucket, replies in answers:
        for s, o, x in zip(sets, out, replies, strict=True):
            part = s.part(bucket)
            o[part] = unpack_counts(x, part.stop - part.start, o[part])
    back = []
    for s, o in zip(sets, out, strict=True):
        given = np.empty_like(o)
        given[s.order] = o
        back.append(given)
    return back
