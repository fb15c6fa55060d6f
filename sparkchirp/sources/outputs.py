"""Outputs of a search: a series file and an information file for each trial, parquet tables, a timing table."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import backend, telescope
from ..functions.numeric import split_angle
from ..spec import f32
from .filterbank import Header, open_path


def trial_name(stem: str, dm: float) -> str:
    return f"{stem}_DM{dm:.3f}"


def information(header: Header, stem: str, dm: float, samples: int) -> str:
    """The text of a trial's information file; labels and layout are fixed values of the format."""
    (ra_h, ra_m, ra_s), (dec_d, dec_m, dec_s) = split_angle(header.src_raj), split_angle(abs(header.src_dej))
    day = math.floor(header.tstart)
    fraction = f"{header.tstart - day:.15f}".partition(".")[2]
    width = abs(header.foff)
    lines = [
        ("Data file name without suffix", trial_name(stem, dm)),
        ("Telescope used", telescope(header.telescope_id)),
        ("Instrument used", backend(header.machine_id)),
        ("Object being observed", header.source_name),
        ("J2000 Right Ascension (hh:mm:ss.ssss)", f"{ra_h:02d}:{ra_m:02d}:{ra_s:f}"),
        ("J2000 Declination     (dd:mm:ss.ssss)", f"{'-' if header.src_dej < 0 else ' '}{dec_d:02d}:{dec_m:02d}:{'0' if dec_s < 10 else ''}{dec_s:f}"),
        ("Data observed by", "Unknown"),
        ("Epoch of observation (MJD)", f"{day}.{fraction}"),
        ("Barycentered?           (1=yes, 0=no)", "0"),
        ("Number of bins in the time series", f"{samples}"),
        ("Width of each time series bin (sec)", f"{header.tsamp:.15g}"),
        ("Any breaks in the data? (1=yes, 0=no)", "0"),
        ("Type of observation (EM band)", "Radio"),
        ("Beam diameter (arcsec)", "3600"),
        ("Dispersion measure (cm-3 pc)", f"{f32(dm):.12g}"),
        ("Central freq of low channel (Mhz)", f"{header.fch1 - (header.nchans - 1) * width:.12g}"),
        ("Total bandwidth (Mhz)", f"{width * header.nchans:.12g}"),
        ("Number of channels", f"{header.nchans}"),
        ("Channel bandwidth (Mhz)", f"{width:.12g}"),
        ("Data analyzed by", "Unknown"),
    ]
    # the sign stands in the place of the second space before the declination
    out = [f" {label:<39}= {'' if label.startswith('J2000 Dec') else ' '}{value}" for label, value in lines]
    return "\n".join([*out, " Any additional notes:", f"    Input filterbank samples have {header.nbits} bits.", ""])


def inf_table(spark: SparkSession, dms, stem: str, samples: int, header: Header | None = None) -> DataFrame:
    """(dm_idx, line_no, line): every line of each trial's information file."""
    header = header or Header(nchans=64, tsamp=6.4e-3, fch1=1581.0, foff=-6.25)
    rows = [(i, k, line) for i, dm in enumerate(dms) for k, line in enumerate(information(header, stem, dm, samples).splitlines())]
    return spark.createDataFrame(rows, "dm_idx int, line_no int, line string")


def write_series(series: DataFrame, header: Header, folder: str, stem: str, count: int | None = None, value: str = "value") -> DataFrame:
    """Write each trial's series (dm_idx, dm, t, value) as 32-bit floats with its information file; gives (dm_idx, path, samples).

    The number of samples is made even; a file appears under its name only when complete.
    """

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        n = table.num_rows if count is None else min(count, table.num_rows)
        n -= n % 2
        dm = table.column("dm")[0].as_py()
        base = f"{folder}/{trial_name(stem, dm)}"
        for suffix, data in ((".dat", np.asarray(table.column("value"))[:n].astype("<f4").tobytes()), (".inf", information(header, stem, dm, n).encode())):
            fs, path = open_path(base + suffix)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            temporary = f"{path}.{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, path)
        return pa.table([pa.array([table.column("dm_idx")[0].as_py()], pa.int32()), pa.array([base + ".dat"]), pa.array([n], pa.int64())], names=["dm_idx", "path", "samples"])

    rows = series.select("dm_idx", F.col("dm").cast("float").alias("dm"), "t", F.col(value).cast("float").alias("value"))
    return rows.groupBy("dm_idx").applyInArrow(work, "dm_idx int, path string, samples long")


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, optionally in one folder a trial."""
    (df.write.partitionBy(by) if by else df.write).parquet(path)


def write_timings(spark: SparkSession, rows: list[tuple[float, float, float, float]], path: str) -> None:
    """Append (input, output, summing, total) seconds as tab-separated text."""
    spark.createDataFrame(rows, "input double, output double, summing double, total double").coalesce(1).write.mode("append").option("sep", "\t").csv(path)
