"""Calibrated recordings: rows of weights, offsets, scales (big-endian floats) and bytes by spectrum, polarisation and channel."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filterbank import open_path


@dataclass(frozen=True)
class Layout:
    """Fixed values of the layout; tests use smaller numbers."""

    nchans: int = 3072
    pols: int = 4
    spectra: int = 10000
    rows: int = 200
    header: int = 5 * 2880
    gap: int = 12364

    @property
    def row_bytes(self) -> int:
        return self.gap + 4 * self.nchans * (1 + 2 * self.pols) + self.spectra * self.pols * self.nchans


def read_subints(spark: SparkSession, uri: str, layout: Layout = Layout()) -> DataFrame:
    """(subint, wts, offs, scl, data): one row of the recording each, read by its own task."""
    n, p = layout.nchans, layout.pols

    def work(batches):
        fs, path = open_path(uri)
        with fs.open_input_file(path) as f:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    f.seek(layout.header + i * layout.row_bytes + layout.gap)
                    floats = np.frombuffer(f.read(4 * n * (1 + 2 * p)), ">f4").astype(np.float32)
                    data = f.read(layout.spectra * p * n)
                    lists = [pa.array([x.tolist()], pa.list_(pa.float32())) for x in (floats[:n], floats[n : n + n * p], floats[n + n * p :])]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *lists, pa.array([data], pa.binary())], names=["subint", "wts", "offs", "scl", "data"])

    rows = spark.range(0, layout.rows, 1, layout.rows).select(F.col("id").cast("int").alias("subint"))
    return rows.mapInArrow(work, "subint int, wts array<float>, offs array<float>, scl array<float>, data binary")


def calibrated(subints: DataFrame, layout: Layout = Layout(), pol: int = 0) -> DataFrame:
    """(t, v): (raw * scale + offset) * weight of one polarisation."""
    n, p, s = layout.nchans, layout.pols, layout.spectra

    def work(batches):
        for batch in batches:
            for i, w, o, c, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(s, p, n)[:, pol, :].astype(np.float32)
                part = slice(pol * n, (pol + 1) * n)
                v = (raw * np.float32(c)[part] + np.float32(o)[part]) * np.float32(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(i * s, (i + 1) * s)), pa.ListArray.from_arrays(pa.array(np.arange(s + 1, dtype=np.int32) * n), pa.array(v.ravel()))], names=["t", "v"]
                )

    return subints.select("subint", "wts", "offs", "scl", "data").mapInArrow(work, "t bigint, v array<float>")


def write_subints(rows: DataFrame, uri: str, layout: Layout = Layout()) -> DataFrame:
    """Write rows (subint, wts, offs, scl, data) as one recording, in order, by one task that holds a row at a time; gives (path, rows)."""

    def work(batches):
        fs, path = open_path(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        count = 0
        with fs.open_output_stream(path + ".tmp") as f:
            f.write(bytes(layout.header))
            for batch in batches:
                for w, o, c, data in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                    f.write(bytes(layout.gap) + np.array([*w, *o, *c], ">f4").tobytes() + data)
                    count += 1
        fs.move(path + ".tmp", path)
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([count], pa.int64())], names=["path", "rows"])

    ordered = rows.select("subint", "wts", "offs", "scl", "data").repartition(1).sortWithinPartitions("subint")
    return ordered.mapInArrow(work, "path string, rows long")
