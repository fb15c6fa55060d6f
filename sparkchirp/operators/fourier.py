"""Channel sums in the frequency domain: delays as phase rotations of each channel's spectrum.

``delay_mode`` rounds delays to whole samples as the time domain does (``rint``), truncates them (``trunc``)
or keeps fractions (``frac``).  Series are padded to at least nsamps + max_delay; long ones are cut
into overlapping segments, of which the samples not touched by wrap-around are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_up
from ..spec import MIN_SEGMENT, ObservationSpec
from .tables import segment_plan
from .timedomain import output_samples, spectra, with_blocks


WHOLE_CELLS = 1 << 26  # samples times channels that one task transforms as a whole: half a gigabyte


def sample_delays(spec: ObservationSpec, dms, mode: str) -> np.ndarray:
    """Delays in samples (trial, channel)."""
    exact = np.asarray(dms, np.float32)[:, None] * spec.delays()[None, :]
    if mode == "rint":
        return np.rint(exact).astype(np.float64)
    if mode == "trunc":
        return np.trunc(exact).astype(np.float64)
    if mode == "frac":
        return exact.astype(np.float64)
    raise ValueError("delay_mode: rint, trunc or frac")


def phasors(delay: float, nfft: int, extrapolate: bool = False, step: int = 32) -> np.ndarray:
    """exp(2 pi i k delay / nfft) for all k; with ``extrapolate`` only every 32nd is computed, the others by multiplying on."""
    k = np.arange(nfft // 2 + 1)
    turn = 2j * np.pi * delay / nfft
    if not extrapolate:
        return np.exp(turn * k)
    heads = np.exp(turn * k[::step])
    return (heads[:, None] * np.exp(turn) ** np.arange(step)[None, :]).ravel()[: len(k)]


def rotate_and_sum(spectrum: np.ndarray, delays: np.ndarray, nfft: int, extrapolate: bool) -> np.ndarray:
    """Spectrum (bins) of one trial from those of the channels (channels x bins)."""
    out = np.zeros(spectrum.shape[1], np.complex128)
    for x, d in zip(spectrum, delays, strict=True):
        out += x * phasors(d, nfft, extrapolate)
    return out


def sums_fourier(
    wide: DataFrame,
    spec: ObservationSpec,
    dms,
    nsamps: int,
    delay_mode: str = "rint",
    segment: int | None = MIN_SEGMENT,
    dm_block: int = 64,
    extrapolate: bool = False,
    first: int = 0,
    count: int | None = None,
) -> DataFrame:
    """(dm_idx, dm, t, value): centred sums over channels divided by their number, of ``count`` trials from ``first`` on.

    ``segment`` is the least length of a transform; None takes the whole series as one padded segment, in one task
    for each block of trials: refused beyond ``WHOLE_CELLS`` samples times channels.
    """
    delay = spec.max_delay(dms)
    good = output_samples(nsamps, delay)
    if segment is None:
        nfft = round_up(nsamps + delay, MIN_SEGMENT)
        if nfft * spec.nchans > WHOLE_CELLS:
            raise ValueError("the series is too long for one transform: give the least length of a segment")
        size = max(1, good)
    else:
        nfft, size, _ = segment_plan(nsamps, delay, segment)
    last = max(0, -(-good // size) - 1)
    delays, keep, values = sample_delays(spec, dms, delay_mode), np.array(spec.killmask), np.asarray(dms, np.float32)
    nchans, stop = spec.nchans, len(dms) if count is None else min(len(dms), first + count)
    if stop <= first or not good:
        return wide.sparkSession.createDataFrame([], "dm_idx int, dm float, t bigint, value double")
    rows = with_blocks(wide.select(F.col("t").cast("bigint").alias("t"), F.col("v").cast("array<double>").alias("v")), size, delay, last)
    rows = rows.select("t", "v", "gulp", F.explode(F.sequence(F.lit(0), F.lit(-(-(stop - first) // dm_block) - 1))).alias("block"))

    def work(table: pa.Table) -> pa.Table:
        g, b = table.column("gulp")[0].as_py(), table.column("block")[0].as_py()
        n = min(size, good - g * size)
        x = spectra(table, g * size, min(nfft, nsamps - g * size), nchans)
        spectrum = np.fft.rfft((x - 127.5) / nchans * keep[:, None], n=nfft, axis=1)
        trials = np.arange(first + b * dm_block, min(stop, first + (b + 1) * dm_block), dtype=np.int32)
        out = np.stack([np.fft.irfft(rotate_and_sum(spectrum, delays[i], nfft, extrapolate), n=nfft)[:n] for i in trials])
        t = np.tile(np.arange(g * size, g * size + n), len(trials))
        return pa.table([pa.array(np.repeat(trials, n)), pa.array(np.repeat(values[trials], n)), pa.array(t), pa.array(out.ravel())], names=["dm_idx", "dm", "t", "value"])

    return rows.groupBy("gulp", "block").applyInArrow(work, "dm_idx int, dm float, t bigint, value double")


def spectra_fourier(
    wide: DataFrame, spec: ObservationSpec, dms, nsamps: int, nfft: int | None = None, delay_mode: str = "rint", channel_block: int = 32, trial_block: int = 64
) -> DataFrame:
    """(dm_idx, dm, k, re, im): the spectrum of every trial, from partial sums over blocks of channels added up by trial and bin.

    A task transforms at most ``WHOLE_CELLS`` samples times channels (the blocks get smaller where series are long) for
    ``trial_block`` trials; one channel of the whole series must fit in that.
    """
    delay = spec.max_delay(dms)
    output_samples(nsamps, delay)
    nfft = nfft or round_up(nsamps + delay, MIN_SEGMENT)
    if nfft > WHOLE_CELLS:
        raise ValueError("the series is too long for one transform")
    width = max(1, min(channel_block, WHOLE_CELLS // nfft))
    trials_each = max(1, min(trial_block, WHOLE_CELLS // nfft))
    delays, keep, values = sample_delays(spec, dms, delay_mode), np.array(spec.killmask), np.asarray(dms, np.float32)
    nchans, count = spec.nchans, len(dms)
    long = wide.select(F.col("t").cast("bigint").alias("t"), F.posexplode(F.col("v").cast("array<double>")).alias("ch", "v")).where((F.col("t") >= 0) & (F.col("t") < nsamps))
    long = long.withColumn("block", F.expr(f"cast(ch div {width} as int)"))
    long = long.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-count // trials_each) - 1))))

    def work(table: pa.Table) -> pa.Table:
        low = table.column("block")[0].as_py() * width
        high = min(nchans, low + width)
        begin = table.column("part")[0].as_py() * trials_each
        x = np.zeros((high - low, nfft))
        np.add.at(x, (np.asarray(table.column("ch")) - low, np.asarray(table.column("t"))), np.asarray(table.column("v")))
        x[:, :nsamps] = (x[:, :nsamps] - 127.5) / nchans * keep[low:high, None]
        spectrum = np.fft.rfft(x, axis=1)
        trials = np.arange(begin, min(count, begin + trials_each), dtype=np.int32)
        out = np.stack([rotate_and_sum(spectrum, delays[i, low:high], nfft, False) for i in trials])
        k = np.tile(np.arange(out.shape[1], dtype=np.int32), len(out))
        return pa.table([pa.array(np.repeat(trials, out.shape[1])), pa.array(k), pa.array(out.real.ravel()), pa.array(out.imag.ravel())], names=["dm_idx", "k", "re", "im"])

    partial = long.groupBy("block", "part").applyInArrow(work, "dm_idx int, k int, re double, im double")
    named = F.element_at(F.array(*[F.lit(float(x)).cast("float") for x in values]), F.col("dm_idx") + 1)
    return partial.groupBy("dm_idx", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).select("dm_idx", named.alias("dm"), "k", "re", "im")


def series_from_spectra(spectrum: DataFrame, nfft: int, good: int) -> DataFrame:
    """(dm_idx, t, value) back from (dm_idx, k, re, im): the inverse transform of every trial, one trial a task."""
    if nfft > WHOLE_CELLS:
        raise ValueError("the series is too long for one transform")

    def work(table: pa.Table) -> pa.Table:
        k = np.asarray(table.column("k"))
        x = np.zeros(nfft // 2 + 1, np.complex128)
        x[k] = np.asarray(table.column("re")) + 1j * np.asarray(table.column("im"))
        out = np.fft.irfft(x, n=nfft)[:good]
        i = table.column("dm_idx")[0].as_py()
        return pa.table([pa.array([i] * good, pa.int32()), pa.array(np.arange(good)), pa.array(out)], names=["dm_idx", "t", "value"])

    return spectrum.select("dm_idx", "k", "re", "im").groupBy("dm_idx").applyInArrow(work, "dm_idx int, t bigint, value double")
