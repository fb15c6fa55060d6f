"""Decimation of whole spectra, and searches at several time resolutions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import ObservationSpec
from .timedomain import sums_blocks


def decimate_wide(wide: DataFrame, factor: int, nsamps: int, block: int = 1024) -> DataFrame:
    """(t, v): whole means of each ``factor`` spectra; an incomplete group at the end is left out."""
    whole = wide.where(F.col("t") < nsamps // factor * factor)
    rows = whole.select(F.expr(f"cast(t div {factor * block} as int)").alias("b"), F.col("t").cast("bigint").alias("t"), F.col("v").cast("array<bigint>").alias("v"))

    def work(table: pa.Table) -> pa.Table:
        t = np.asarray(table.column("t")) // factor
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(t), -1)
        order = np.argsort(t, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(t[order]) > 0]))
        sums = np.add.reduceat(v[order], first, axis=0) // factor
        offsets = np.arange(len(first) + 1, dtype=np.int32) * v.shape[1]
        return pa.table([pa.array(t[order][first]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))], names=["t", "v"])

    return rows.groupBy("b").applyInArrow(work, "t bigint, v array<bigint>")


def resolution_factors(spec: ObservationSpec, dms, pulse_width: float, tolerance: float) -> list[int]:
    """For each trial the largest power of two by which samples may be joined without the smearing growing by more than ``tolerance``."""
    band = spec.nchans * abs(spec.df)
    middle = spec.f0 - band / 2
    out = []
    for dm in dms:
        inside = 8.3e3 * abs(spec.df) * float(dm) / middle**3 * 1e6  # microseconds of smearing in a channel
        smear = np.sqrt((spec.dt * 1e6) ** 2 + pulse_width**2 + inside**2)
        k = 1
        while np.sqrt((2 * k * spec.dt * 1e6) ** 2 + pulse_width**2 + inside**2) <= tolerance * smear:
            k *= 2
        out.append(k)
    return out


def sums_scrunched(wide: DataFrame, spec: ObservationSpec, dms, nsamps: int, factors: list[int], **options) -> DataFrame:
    """(dm_idx, dm, t, sum, factor): each trial on samples joined by its factor; t counts joined samples."""
    out = None
    for k in sorted(set(factors)):
        mine = [i for i, f in enumerate(factors) if f == k]
        coarse = ObservationSpec(spec.nchans, spec.dt * k, spec.f0, spec.df, spec.killmask)
        data = wide if k == 1 else decimate_wide(wide, k, nsamps)
        sums = sums_blocks(data, coarse, [dms[i] for i in mine], nsamps // k, **options)
        number = F.element_at(F.array(*[F.lit(i) for i in mine]), F.col("dm_idx") + 1)
        part = sums.withColumn("dm_idx", number).withColumn("factor", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
