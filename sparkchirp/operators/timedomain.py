"""Channel sums in the time domain: a broadcast join with a grouped sum, or Arrow kernels on blocks of time.

Both give S[dm, t] = sum over channels of keep[ch] * x[t + shift(dm, ch), ch] for 0 <= t < nsamps - max_delay.
The relational form makes a row for each sample and trial before the sum, which suits short
data and any SQL around it; the block form reads each spectrum once for each block of trials and is the one
for large data.  In every form, in the frequency domain and in streams, a missing spectrum counts as zeros, and rows
that repeat a time add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import scale_output
from ..spec import GULP_SIZE, Code, ObservationSpec, SearchError
from .tables import shift_matrix

BLOCK_CELLS = 16 << 20  # outputs of a task
BROADCAST_CELLS = 2_000_000  # rows of the shift matrix that may be broadcast, about 60 MB


def to_long(wide: DataFrame) -> DataFrame:
    """(t, ch, v) of spectra (t, v array)."""
    return wide.select("t", F.posexplode("v").alias("ch", "v"))


def to_wide(long: DataFrame) -> DataFrame:
    """(t, v array) of samples (t, ch, v); every channel must be there."""
    return long.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "v"))), lambda x: x["v"]).alias("v"))


def channel_major(long: DataFrame, block: int | None = None) -> DataFrame:
    """(ch, block, v array by t): the transpose of the spectra, a row for each channel and ``block`` samples, so that no row
    grows with the series; without ``block`` (ch, v), where each channel's series must fit in a row."""
    series = F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("v")
    if block is None:
        return long.groupBy("ch").agg(series)
    return long.groupBy("ch", F.expr(f"t div {block}").alias("block")).agg(series)


def output_samples(nsamps: int, max_delay: int) -> int:
    if nsamps < max_delay:
        raise SearchError(Code.TOO_FEW_NSAMPS)
    return nsamps - max_delay


def sums_relational(long: DataFrame, spec: ObservationSpec, dms, nsamps: int, first: int = 0, count: int | None = None) -> DataFrame:
    """(dm_idx, dm, t, sum) by join and group; trials with no channel left still have sums of 0, but a sum that no sample at
    all contributes to (every channel's spectrum is missing) has no row here."""
    good = output_samples(nsamps, spec.max_delay(dms))
    shifts = shift_matrix(long.sparkSession, spec, dms, first, count)
    if len(dms) * spec.nchans <= BROADCAST_CELLS:
        shifts = F.broadcast(shifts)
    moved = long.join(shifts, "ch").select("dm_idx", "dm", (F.col("t") - F.col("shift")).alias("t"), (F.col("v") * F.col("keep")).alias("v"))
    return moved.where((F.col("t") >= 0) & (F.col("t") < good)).groupBy("dm_idx", "dm", "t").agg(F.sum("v").cast("bigint").alias("sum"))


def sums_subbands(long: DataFrame, spec: ObservationSpec, dms, nsamps: int, bands: int) -> DataFrame:
    """(dm_idx, dm, band, t, sum): sums over each of ``bands`` equal groups of channels; ``add_subbands`` joins them."""
    good = output_samples(nsamps, spec.max_delay(dms))
    shifts = shift_matrix(long.sparkSession, spec, dms)
    if len(dms) * spec.nchans <= BROADCAST_CELLS:
        shifts = F.broadcast(shifts)
    band = F.floor(F.col("ch") * bands / spec.nchans).cast("int")
    moved = long.join(shifts, "ch").select("dm_idx", "dm", band.alias("band"), (F.col("t") - F.col("shift")).alias("t"), (F.col("v") * F.col("keep")).alias("v"))
    return moved.where((F.col("t") >= 0) & (F.col("t") < good)).groupBy("dm_idx", "dm", "band", "t").agg(F.sum("v").cast("bigint").alias("sum"))


def add_subbands(bands: DataFrame) -> DataFrame:
    return bands.groupBy("dm_idx", "dm", "t").agg(F.sum("sum").cast("bigint").alias("sum"))


def block_sums(x: np.ndarray, shifts: np.ndarray, keep: np.ndarray, n: int) -> np.ndarray:
    """Sums (trials x n) of a block x (channels x samples); shifts (trials x channels).

    From one trial to the next only channels whose shift changes are exchanged, where that is less work.
    16-bit samples are added up in 16 bits for as many channels as cannot overflow, then in 32.
    """
    narrow = x.dtype == np.uint16
    out = np.empty((len(shifts), n), np.int32 if narrow else x.dtype)
    alive = np.flatnonzero(keep)
    few = max(1, 65535 // max(1, int(x.max()))) if narrow and x.size else len(alive)
    part = np.empty(n, x.dtype)
    before = None
    for i, row in enumerate(shifts):
        changed = alive if before is None else alive[row[alive] != before[alive]]
        acc = out[i]
        if before is not None and (4 if narrow else 2) * len(changed) < len(alive):
            acc[:] = out[i - 1]
            for c in changed.tolist():
                acc -= x[c, before[c] : before[c] + n]
                acc += x[c, row[c] : row[c] + n]
        else:
            acc[:] = 0
            for a in range(0, len(alive), max(1, few)):
                into = part if narrow else acc
                if narrow:
                    part[:] = 0
                for c in alive[a : a + few].tolist():
                    into += x[c, row[c] : row[c] + n]
                if narrow:
                    acc += part
        before = row
    return out


def with_blocks(wide: DataFrame, size: int, halo: int, last: int) -> DataFrame:
    """``wide`` with the number of every block that needs the spectrum: blocks of ``size`` outputs and ``halo`` samples more."""
    low = F.greatest(F.floor((F.col("t") - halo) / size), F.lit(0))
    high = F.least(F.floor(F.col("t") / size), F.lit(last))
    return wide.where(F.col("t") >= 0).where(low <= high).select("*", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("gulp"))


def spectra(table: pa.Table, begin: int, samples: int, nchans: int) -> np.ndarray:
    """The spectra of a table (t, v) as an array channels x samples from time ``begin``; missing ones are 0, repeated ones add up."""
    t = np.asarray(table.column("t")) - begin
    v = table.column("v").combine_chunks()
    flat = np.asarray(v.flatten()).reshape(len(t), -1)[:, :nchans]
    ok = (t >= 0) & (t < samples)
    if not ok.all():
        t, flat = t[ok], flat[ok]
    if len(t) and np.bincount(t).max() > 1:
        order = np.argsort(t, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(t[order]) > 0]))
        t, flat = t[order][first], np.add.reduceat(flat[order], first, axis=0, dtype=np.int64 if flat.dtype.kind in "iu" else flat.dtype)
    kind = flat.dtype
    if kind.kind in "iu":  # as few bits as sums over channels allow: less memory traffic
        low, top = (int(flat.min()), int(flat.max())) if flat.size else (0, 0)
        wide = max(-low, top) * nchans >= 1 << 31
        kind = np.int64 if wide else np.uint16 if low >= 0 and top < 4096 else np.int32
    out = np.zeros((nchans, samples), kind)
    out[:, t] = flat.T
    return out


def sums_blocks(
    wide: DataFrame,
    spec: ObservationSpec,
    dms,
    nsamps: int,
    gulp: int = GULP_SIZE,
    dm_block: int | None = None,
    first: int = 0,
    count: int | None = None,
    arrays: bool = False,
) -> DataFrame:
    """(dm_idx, dm, t, sum), or with ``arrays`` (dm_idx, dm, gulp, sums), from kernels on (gulp, block of trials).

    Each block of trials reads a copy of the spectra, so without ``dm_block`` there are just as many blocks
    as keep a task's output below ``BLOCK_CELLS`` and the cores busy: one, where there are many gulps.
    """
    delay = spec.max_delay(dms)
    good = output_samples(nsamps, delay)
    last = len(dms) if count is None else min(len(dms), first + count)
    gulp = max(1, min(gulp, good or 1))
    shifts, keep = spec.shifts(dms), np.array(spec.killmask)
    values = np.asarray(dms, np.float32)
    trials = max(1, last - first)
    if dm_block is None:
        cores = wide.sparkSession.sparkContext.defaultParallelism
        wanted = max(-(-trials * gulp // BLOCK_CELLS), -(-cores // max(1, -(-good // gulp))))
        dm_block = -(-trials // min(trials, wanted))
    nblocks = -(-trials // dm_block)
    kind = wide.schema["v"].dataType.elementType.simpleString()
    v = F.col("v") if kind in ("tinyint", "smallint", "int", "bigint") else F.col("v").cast("array<bigint>")
    rows = with_blocks(wide.select(F.col("t").cast("bigint").alias("t"), v.alias("v")), gulp, delay, max(0, -(-good // gulp) - 1))
    rows = rows.select("t", "v", "gulp", F.explode(F.sequence(F.lit(0), F.lit(nblocks - 1))).alias("block"))
    nchans = spec.nchans

    def work(table: pa.Table) -> pa.Table:
        g, b = table.column("gulp")[0].as_py(), table.column("block")[0].as_py()
        n = min(gulp, good - g * gulp)
        a, z = first + b * dm_block, min(last, first + (b + 1) * dm_block)
        trial = np.arange(a, z, dtype=np.int32)
        sums = block_sums(spectra(table, g * gulp, n + delay, nchans), shifts[a:z], keep, n)
        if arrays:
            offsets = np.arange(len(trial) + 1, dtype=np.int32) * n
            cols = [pa.array(trial), pa.array(values[a:z]), pa.array([g] * len(trial), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel().astype(np.int64)))]
            return pa.table(cols, names=["dm_idx", "dm", "gulp", "sums"])
        t = np.tile(np.arange(g * gulp, g * gulp + n), len(trial))
        return pa.table([pa.array(np.repeat(trial, n)), pa.array(np.repeat(values[a:z], n)), pa.array(t), pa.array(sums.ravel().astype(np.int64))], names=["dm_idx", "dm", "t", "sum"])

    schema = "dm_idx int, dm float, gulp int, sums array<bigint>" if arrays else "dm_idx int, dm float, t bigint, sum bigint"
    if last <= first or not good:
        return wide.sparkSession.createDataFrame([], schema)
    return rows.groupBy("gulp", "block").applyInArrow(work, schema)


def scaled(sums: DataFrame, spec: ObservationSpec, in_nbits: int, out_nbits: int) -> DataFrame:
    """``sums`` with the value at the output depth."""
    return sums.withColumn("value", scale_output(F.col("sum"), in_nbits, out_nbits, spec.nchans))
