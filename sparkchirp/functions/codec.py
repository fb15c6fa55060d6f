"""Packed samples: 1, 2, 4, 8, 16 or 32 bits each, least significant bits first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import IN_NBITS, Code, SearchError


def check_depth(nbits: int) -> None:
    if nbits not in IN_NBITS:
        raise SearchError(Code.UNSUPPORTED_IN_NBITS)


def subword(word: Column, k: Column, nbits: int) -> Column:
    """Sample ``k`` of a 32-bit word held in a BIGINT; the shift is a division, so it may vary by row."""
    return (F.floor(word / F.pow(F.lit(2.0), k * nbits)).cast("bigint")).bitwiseAND(F.lit((1 << nbits) - 1)).cast("bigint")


def expand(word: Column, nbits: int) -> Column:
    """All samples of a 32-bit word, as an array."""
    check_depth(nbits)
    mask = F.lit((1 << nbits) - 1).cast("bigint")
    return F.array(*[F.shiftright(word.cast("bigint"), k * nbits).bitwiseAND(mask) for k in range(32 // nbits)])


def rescale(v: Column, in_nbits: int, out_nbits: int) -> Column:
    """A sample stretched to a wider depth: v * (2^out - 1) / (2^in - 1), truncated."""
    return F.floor(v * F.lit((1 << out_nbits) - 1) / F.lit((1 << in_nbits) - 1)).cast("bigint")


def unpack_bytes(raw: np.ndarray, nbits: int) -> np.ndarray:
    """Samples of rows of packed bytes (rows x bytes)."""
    check_depth(nbits)
    if nbits >= 8:
        return np.ascontiguousarray(raw).view(f"<u{nbits // 8}")
    bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(raw), -1, nbits)
    return (bits << np.arange(nbits, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def pack_samples(samples: np.ndarray, nbits: int) -> np.ndarray:
    """Rows of packed bytes of rows of samples; rows that end inside a byte are filled with zeros."""
    check_depth(nbits)
    if nbits >= 8:
        return np.ascontiguousarray(samples.astype(f"<u{nbits // 8}")).view(np.uint8)
    bits = (samples[:, :, None].astype(np.int64) >> np.arange(nbits)) & 1
    return np.packbits(bits.reshape(len(samples), -1).astype(np.uint8), axis=1, bitorder="little")


def unpack(df: DataFrame, nbits: int, nchans: int, raw: str = "raw", stride: int | None = None) -> DataFrame:
    """(t, v) of packed spectra (t, raw); bytes beyond the row (``stride``) are ignored."""
    check_depth(nbits)
    need = -(-nchans * nbits // 8)
    if stride is not None and stride < need:
        raise SearchError(Code.INVALID_STRIDE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            packed = np.frombuffer(b"".join(x[:need] for x in rows), np.uint8).reshape(len(rows), need)
            v = unpack_bytes(packed, nbits)[:, :nchans].astype(np.int64)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * nchans
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], names=["t", "v"])

    return df.select(F.col("t").cast("bigint").alias("t"), F.col(raw)).mapInArrow(work, "t bigint, v array<bigint>")


def pack(df: DataFrame, nbits: int) -> DataFrame:
    """(t, raw) of spectra (t, v)."""
    check_depth(nbits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).to_pylist()
            packed = pack_samples(np.array(v, np.int64), nbits) if v else np.zeros((0, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], names=["t", "raw"])

    return df.select(F.col("t").cast("bigint").alias("t"), F.col("v").cast("array<bigint>").alias("v")).mapInArrow(work, "t bigint, raw binary")


def swap_endian(values: bytes) -> bytes:
    """32-bit words with their bytes reversed."""
    return np.frombuffer(values, ">u4").astype("<u4").tobytes()


def swap_word(word: Column) -> Column:
    """A 32-bit word held in a BIGINT with its bytes reversed."""
    byte = lambda k: F.shiftright(word.cast("bigint"), 8 * k).bitwiseAND(F.lit(255).cast("bigint"))
    return F.shiftleft(byte(0), 24).bitwiseOR(F.shiftleft(byte(1), 16)).bitwiseOR(F.shiftleft(byte(2), 8)).bitwiseOR(byte(3))
