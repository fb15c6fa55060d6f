"""Filterbank files: a header of length-prefixed keys, then samples by time and channel.

``spark.dataSource.register(FilterbankSource)`` gives the formats ``filterbank`` (with header) and ``rawbank``
(bytes alone; options nchans, nbits, stride, skip).  A partition is a range of samples; the number of samples
follows from the file size, not from the header.  Paths may name any file system that pyarrow knows.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import asdict, dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codec import check_depth, pack_samples, unpack_bytes
from ..spec import Code, ObservationSpec, SearchError


#: The narrowest types that hold unsigned samples of each depth: they are what is shuffled.
SAMPLES = {**dict.fromkeys((1, 2, 4, 8), ("smallint", np.int16)), 16: ("int", np.int32), 32: ("bigint", np.int64)}


@dataclass
class Header:
    """Fields of a file header under their keys."""

    tsamp: float = 0.0
    tstart: float = 0.0
    fch1: float = 0.0
    foff: float = 0.0
    nchans: int = 0
    nifs: int = 1
    nbits: int = 8
    nsamples: int = 0
    az_start: float = 0.0
    za_start: float = 0.0
    src_raj: float = 0.0
    src_dej: float = 0.0
    telescope_id: int = 0
    machine_id: int = 0
    nbeams: int = 0
    ibeam: int = 0
    source_name: str = ""

    def spec(self) -> ObservationSpec:
        return ObservationSpec(self.nchans, self.tsamp, self.fch1, self.foff)


_KINDS = {f.name: {"float": "<d", "int": "<i", "str": "s"}[str(f.type)] for f in fields(Header)}


def open_path(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def parse_header(data: bytes) -> tuple[Header, int]:
    """(header, its size).  Lengths outside 2 to 79 are skipped four bytes at a time, so unknown fields do no harm."""
    header, at = Header(), 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise SearchError(Code.INVALID_POINTER)
        at += n
        return data[at - n : at]

    while True:
        (n,) = struct.unpack("<i", take(4))
        if not 1 < n < 80:
            continue
        if at + n > len(data):
            raise SearchError(Code.INVALID_POINTER)
        key = take(n).decode("latin-1")
        if key == "HEADER_END":
            return header, at
        kind = _KINDS.get(key)
        if kind == "s":
            (n,) = struct.unpack("<i", take(4))
            setattr(header, key, take(n).decode("latin-1"))
        elif kind:
            setattr(header, key, struct.unpack(kind, take(struct.calcsize(kind)))[0])


def header_bytes(header: Header) -> bytes:
    text = lambda s: struct.pack("<i", len(s)) + s.encode("latin-1")
    out = [text("HEADER_START")]
    for key, value in asdict(header).items():
        kind = _KINDS[key]
        if kind == "s":
            if value:
                out += [text(key), text(value)]
        else:
            out += [text(key), struct.pack(kind, value)]
    return b"".join([*out, text("HEADER_END")])


def read_header(uri: str) -> tuple[Header, int, int]:
    """(header, size of the header, samples in the file)."""
    fs, path = open_path(uri)
    with fs.open_input_file(path) as f:
        header, size = parse_header(f.read(1 << 16))
        body = f.size() - size
    check_depth(header.nbits)
    row = header.nchans * header.nifs * header.nbits // 8
    return header, size, body // row


@dataclass
class Range(InputPartition):
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, header: bool):
        self.uri = options["path"]
        self.samples_each = int(options.get("samples", 1 << 16))
        if header:
            h, self.skip, self.samples = read_header(self.uri)
            if h.nifs != 1:
                raise SearchError(Code.INVALID_PLAN)
            self.nchans, self.nbits = h.nchans, h.nbits
            self.need = self.stride = -(-h.nchans * h.nbits // 8)
        else:
            self.nchans, self.nbits, self.skip = int(options["nchans"]), int(options.get("nbits", 8)), int(options.get("skip", 0))
            check_depth(self.nbits)
            self.need = -(-self.nchans * self.nbits // 8)
            self.stride = int(options.get("stride", self.need))
            if self.stride < self.need:
                raise SearchError(Code.INVALID_STRIDE)
            fs, path = open_path(self.uri)
            size = fs.get_file_info(path).size - self.skip
            self.samples = size // self.stride + (size % self.stride >= self.need)

    def partitions(self):
        return [Range(a, min(self.samples, a + self.samples_each)) for a in range(0, self.samples, self.samples_each)]

    def read(self, partition: Range):
        if partition is None or partition.end <= partition.begin:
            return
        fs, path = open_path(self.uri)
        with fs.open_input_file(path) as f:
            for a in range(partition.begin, partition.end, 4096):
                b = min(partition.end, a + 4096)
                f.seek(self.skip + a * self.stride)
                raw = f.read((b - a) * self.stride)
                raw += bytes((b - a) * self.stride - len(raw))
                packed = np.frombuffer(raw, np.uint8).reshape(b - a, self.stride)[:, : self.need]
                v = unpack_bytes(np.ascontiguousarray(packed), self.nbits)[:, : self.nchans].astype(SAMPLES[self.nbits][1])
                offsets = np.arange(b - a + 1, dtype=np.int32) * self.nchans
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], names=["t", "v"])


class FilterbankSource(DataSource):
    """(t, v) of a file with a header."""

    @classmethod
    def name(cls):
        return "filterbank"

    def schema(self):
        return f"t bigint, v array<{SAMPLES[read_header(self.options['path'])[0].nbits][0]}>"

    def reader(self, schema):
        return _Reader(self.options, True)


class RawbankSource(FilterbankSource):
    """(t, v) of a file of samples alone."""

    @classmethod
    def name(cls):
        return "rawbank"

    def schema(self):
        nbits = int(self.options.get("nbits", 8))
        check_depth(nbits)
        return f"t bigint, v array<{SAMPLES[nbits][0]}>"

    def reader(self, schema):
        return _Reader(self.options, False)


def read_filterbank(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FilterbankSource)
    return spark.read.format("filterbank").options(path=path, **options).load()


def read_raw(spark: SparkSession, path: str, nchans: int, nbits: int = 8, **options) -> DataFrame:
    spark.dataSource.register(RawbankSource)
    return spark.read.format("rawbank").options(path=path, nchans=nchans, nbits=nbits, **options).load()


def _write_parts(wide: DataFrame, folder: str, suffix: str, nbits: int, samples: int, encode) -> DataFrame:
    """A file of each ``samples`` consecutive spectra, its bytes by ``encode`` (part, spectra); a file appears when complete."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        part = table.column("part")[0].as_py()
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)
        uri = f"{folder}/part-{part:05d}.{suffix}"
        fs, path = open_path(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temporary) as f:
            f.write(encode(part, v))
        fs.move(temporary, path)
        return pa.table([pa.array([part], pa.int32()), pa.array([uri]), pa.array([table.num_rows], pa.int64())], names=["part", "path", "samples"])

    rows = wide.select(F.floor(F.col("t") / samples).cast("int").alias("part"), "t", F.col("v").cast(f"array<{SAMPLES[nbits][0]}>").alias("v"))
    return rows.groupBy("part").applyInArrow(work, "part int, path string, samples long")


def write_filterbank(wide: DataFrame, header: Header, folder: str, samples: int = 1 << 20) -> DataFrame:
    """Write spectra (t, v) as files of ``samples`` consecutive samples, each with the header and its own start; gives (part, path, samples)."""
    base = asdict(header)
    check_depth(header.nbits)

    def encode(part: int, v: np.ndarray) -> bytes:
        own = Header(**base | {"nsamples": len(v), "tstart": base["tstart"] + part * samples * base["tsamp"] / 86400.0})
        return header_bytes(own) + pack_samples(v, own.nbits).tobytes()

    return _write_parts(wide, folder, "fil", header.nbits, samples, encode)


def write_raw(wide: DataFrame, nbits: int, folder: str, stride: int | None = None, samples: int = 1 << 20) -> DataFrame:
    """Write spectra (t, v) as files of packed samples alone, each spectrum filled up to ``stride`` bytes; gives (part, path, samples)."""
    check_depth(nbits)

    def encode(part: int, v: np.ndarray) -> bytes:
        packed = pack_samples(v, nbits).reshape(len(v), -1)
        if stride is not None and stride < packed.shape[1]:
            raise SearchError(Code.INVALID_STRIDE)
        return np.pad(packed, ((0, 0), (0, (stride or packed.shape[1]) - packed.shape[1]))).tobytes()

    return _write_parts(wide, folder, "raw", nbits, samples, encode)
