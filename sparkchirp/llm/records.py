"""Token ids as length-delimited binary records.

A data file is a sequence of frames: 8-byte length, masked checksum of these 8 bytes, payload, masked
checksum of the payload (CRC-32, rotated right by 15 bits, plus a constant; all little-endian).  A payload is
one flag byte (1: the id is null), the 8-byte record id and the token ids at a fixed width.  Beside each data
file lies an index file: a header (magic, token width, records), the byte offset of every frame and the
number of tokens of every record, and a checksum; with it a reader can fetch records in any order.

Tasks write under an attempt's own name and rename when complete, and only files named by the returned
manifest are read, so lost executors and repeated attempts leave no half-written or doubled records.  Paths
may name any file system that ``pyarrow.fs`` knows; the folder must be shared.

Defined cases: null text counts as empty (a record of the end id alone); null ids come first and are kept as
null; rows that repeat give a record each; an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fan_out, materialise, new_path, small_batches, text_blocks, text_size, tidied
from .tokens import encoder

MAGIC = b"SCTI0001"
MASK = 0xA282EAD8
BATCH = 4096  # records a batch of what is read
MANIFEST = "shard int, path string, records long, tokens long, bytes long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class RecordWriter:
    """Writes one data file and its index."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = open_store(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.width, self.offsets, self.counts, self.at = width, [], [], 0

    def add(self, key: int | None, ids: bytes) -> None:
        payload = struct.pack("<Bq", key is None, key or 0) + ids
        data = frame(payload)
        self.out.write(data)
        self.offsets.append(self.at)
        self.counts.append(len(ids) // self.width)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        body = MAGIC + struct.pack("<IQ", self.width, len(self.offsets)) + np.array(self.offsets, "<u8").tobytes() + np.array(self.counts, "<u8").tobytes()
        with self.fs.open_output_stream(self.part + ".idx", compression=None) as f:
            f.write(body + struct.pack("<I", masked(body)))
        self.fs.move(self.part + ".idx", self.path + ".idx")
        self.fs.move(self.part, self.path)


class RecordReader:
    """Reads a data file through its index, in order or in any other."""

    def __init__(self, uri: str):
        self.fs, self.path = open_store(uri)
        with self.fs.open_input_stream(self.path + ".idx", compression=None) as f:
            body = f.read()
        if body[:8] != MAGIC or struct.unpack("<I", body[-4:])[0] != masked(body[:-4]):
            raise ValueError(f"damaged index: {self.path}.idx")
        self.width, n = struct.unpack("<IQ", body[8:20])
        self.offsets = np.frombuffer(body, "<u8", n, 20)
        self.counts = np.frombuffer(body, "<u8", n, 20 + 8 * n)

    def __len__(self) -> int:
        return len(self.offsets)

    def records(self, order=None) -> Iterator[tuple[int | None, bytes]]:
        """(id, packed token ids) of the records in ``order`` (their numbers; none: as written)."""
        with self.fs.open_input_file(self.path) if order is not None else self.fs.open_input_stream(self.path, compression=None, buffer_size=1 << 20) as f:
            for i in range(len(self)) if order is None else order:
                if order is not None:
                    f.seek(int(self.offsets[i]))
                head = f.read(12)
                if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
                    raise ValueError(f"damaged length of record {i} in {self.path}")
                data = f.read(struct.unpack("<Q", head[:8])[0] + 4)
                payload = data[:-4]
                if struct.unpack("<I", data[-4:])[0] != masked(payload):
                    raise ValueError(f"damaged record {i} in {self.path}")
                null, key = struct.unpack("<Bq", payload[:9])
                yield None if null else key, payload[9:]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` and write the records in ascending id order; gives the manifest.

    Shards are ranges of ids, numbered in ascending order; the ids themselves are read as 64-bit integers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    _, size = text_size(rows)
    ranged = rows.repartitionByRange(fan_out(spark, size), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text"))

    def work(batches):
        enc, out = encoder(tokenizer), None
        shard = TaskContext.get().partitionId()
        path = f"{folder}/tokens-{shard:06d}-{uuid.uuid4().hex[:8]}.rec"
        end = np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_blocks(text):
                out = out or RecordWriter(path, enc.width)
                for key, packed in zip(ids[a:b], enc.packed(text[a:b]), strict=True):
                    out.add(key, packed + end)
        if out:
            out.close()
            cols = [[shard], [path], [len(out.counts)], [sum(out.counts)], [out.at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "path", "records", "tokens", "bytes"])

    return materialise(small_batches(ranged).mapInArrow(tidied(work), MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every record, read from the files of a manifest; start counts all tokens
    before it, ids are little-endian unsigned 32-bit integers.

    The manifest has one row a file, so the running sum over it is small.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    files = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    schema = "id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = RecordReader(path)
                kind = f"<u{reader.width}"
                counts = reader.counts.astype(np.int64)
                starts = at + np.cumsum(counts) - counts
                keys, crcs, kept, begin = [], [], [], 0
                for i, (key, ids) in enumerate(reader.records()):
                    wide = np.frombuffer(ids, kind).astype("<u4")
                    keys.append(key)
                    crcs.append(zlib.crc32(wide))
                    if with_ids:
                        kept.append(wide.tobytes())
                    if i + 1 == len(reader) or len(keys) == BATCH:
                        cols = [pa.array(keys, pa.int64()), pa.array(starts[begin : i + 1]), pa.array(counts[begin : i + 1]), pa.array(crcs, pa.int64())]
                        yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.binary())] if with_ids else [])], names=names)
                        keys, crcs, kept, begin = [], [], [], i + 1

    return files.mapInArrow(work, schema)


def token_folder(spark) -> str:
    return new_path(spark, "tokens")
