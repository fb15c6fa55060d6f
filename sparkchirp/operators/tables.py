"""Small parameter tables as DataFrames, each from a range and expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import dm_delay, flt, shift
from ..spec import DISPERSION, MIN_SEGMENT, Code, ObservationSpec, SearchError, f32


def _pick(values, kind: str, index: Column) -> Column:
    """Element of a short constant list."""
    return F.element_at(F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>"), index.cast("int") + 1)


def frequency(spec: ObservationSpec, ch: Column) -> Column:
    return flt(spec.f0) + ch.cast("float") * flt(spec.df)


def unit_delay(spec: ObservationSpec, ch: Column) -> Column:
    """Samples of delay for one unit of dispersion measure."""
    a = (F.lit(1.0) / frequency(spec, ch).cast("double")).cast("float")
    b = (F.lit(1.0) / flt(spec.f0).cast("double")).cast("float")
    return (F.lit(DISPERSION) / flt(spec.dt).cast("double") * (a * a - b * b).cast("double")).cast("float")


def delay_table(spark: SparkSession, spec: ObservationSpec) -> DataFrame:
    """(ch, freq, fd)"""
    ch = F.col("id").cast("int")
    return spark.range(0, spec.nchans, 1, 1).select(ch.alias("ch"), frequency(spec, ch).alias("freq"), unit_delay(spec, ch).alias("fd"))


def dm_table(spark: SparkSession, dms) -> DataFrame:
    """(dm_idx, dm)"""
    return spark.range(0, len(dms), 1, 1).select(F.col("id").cast("int").alias("dm_idx"), _pick([f32(x) for x in dms], "float", F.col("id")).alias("dm"))


def linear_dm_table(spark: SparkSession, start: float, step: float, count: int) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(0, count, 1, 1).select(i.alias("dm_idx"), (flt(start) + flt(step) * i.cast("float")).alias("dm"))


def killmask_table(spark: SparkSession, spec: ObservationSpec) -> DataFrame:
    """(ch, keep)"""
    return spark.range(0, spec.nchans, 1, 1).select(F.col("id").cast("int").alias("ch"), _pick(spec.killmask, "int", F.col("id")).alias("keep"))


def shift_matrix(spark: SparkSession, spec: ObservationSpec, dms, first: int = 0, count: int | None = None) -> DataFrame:
    """(dm_idx, dm, ch, shift, keep) for every trial and channel: one range, no join."""
    last = len(dms) if count is None else min(len(dms), first + count)
    n = spec.nchans
    trial, ch = F.expr(f"cast(id div {n} as int)"), (F.col("id") % n).cast("int")
    rows = spark.range(first * n, max(first, last) * n, 1, max(1, (last - first) * n // 1_000_000 + 1))
    rows = rows.select(trial.alias("dm_idx"), ch.alias("ch")).withColumn("dm", _pick([f32(x) for x in dms], "float", F.col("dm_idx")))
    return rows.select("dm_idx", "dm", "ch", shift(F.col("dm"), unit_delay(spec, F.col("ch"))).alias("shift"), _pick(spec.killmask, "int", F.col("ch")).alias("keep"))


def max_delay_table(spark: SparkSession, spec: ObservationSpec, dms) -> DataFrame:
    """(max_delay): one row."""
    fd = delay_table(spark, spec).where(F.col("ch") == spec.nchans - 1).select("fd")
    top = dm_table(spark, dms).agg(F.max("dm").alias("dm"))
    return top.select(dm_delay(F.col("dm"), fd.scalar()).alias("max_delay"))


def dm_delay_table(spark: SparkSession, spec: ObservationSpec, dms) -> DataFrame:
    """(dm_idx, dm, delay): delay of every trial in the last channel."""
    last = F.lit(spec.nchans - 1)
    return dm_table(spark, dms).select("dm_idx", "dm", dm_delay(F.col("dm"), unit_delay(spec, last)).alias("delay"))


def spin_table(spark: SparkSession, dt: float, n: int) -> DataFrame:
    """(k, f): spin frequencies of a real transform of n samples."""
    k = F.col("id").cast("int")
    return spark.range(0, n // 2 + 1).select(k.alias("k"), (k.cast("double") / F.lit(n * f32(dt))).cast("float").alias("f"))


def segment_plan(nsamps: int, max_delay: int, start: int = MIN_SEGMENT, overlap: float = 0.2) -> tuple[int, int, int]:
    """(length of a transform, good samples of it, number of segments): the length doubles until the delay is at most ``overlap`` of it."""
    if nsamps < max_delay:
        raise SearchError(Code.TOO_FEW_NSAMPS)
    nfft = start
    while overlap * nfft < max_delay:
        nfft *= 2
    good = nfft - max_delay
    return nfft, good, max(1, -(-nsamps // good))


def segment_table(spark: SparkSession, nsamps: int, max_delay: int, start: int = MIN_SEGMENT) -> DataFrame:
    """(chunk, isamp_start, isamp_end, ifreq_start, ifreq_end, nfreq_good)"""
    nfft, good, count = segment_plan(nsamps, max_delay, start)
    c = F.col("id").cast("bigint")
    bins = nfft // 2 + 1
    return spark.range(0, count).select(
        c.cast("int").alias("chunk"),
        (c * good).alias("isamp_start"),
        F.least(c * good + nfft, F.lit(nsamps).cast("bigint")).alias("isamp_end"),
        (c * bins).alias("ifreq_start"),
        ((c + 1) * bins).alias("ifreq_end"),
        F.lit(bins).alias("nfreq_good"),
    )


def segment_spin_table(spark: SparkSession, dt: float, nsamps: int, max_delay: int, start: int = MIN_SEGMENT) -> DataFrame:
    """(chunk, k, f): the spin frequencies repeated for each segment."""
    nfft, _, count = segment_plan(nsamps, max_delay, start)
    bins = nfft // 2 + 1
    k = (F.col("id") % bins).cast("int")
    return spark.range(0, count * bins).select(F.expr(f"cast(id div {bins} as int)").alias("chunk"), k.alias("k"), (k.cast("double") / F.lit(nfft * f32(dt))).cast("float").alias("f"))
