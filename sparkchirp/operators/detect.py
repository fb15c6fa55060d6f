"""Statistics, peaks, pulse injection and time decimation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import flt
from ..plans.shipping import shared_path
from ..spec import ObservationSpec
from .tables import shift_matrix


def statistics(series: DataFrame, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """(count, min, max, mean, sample standard deviation), over all rows or by columns."""
    v = F.col(value).cast("double")
    aggregates = [F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")]
    return series.groupBy(*by).agg(*aggregates) if by else series.agg(*aggregates)


def peaks(series: DataFrame, sigma: float = 6.0, limit: int = 101, value: str = "value") -> DataFrame:
    """The first ``limit`` samples, by trial and time, that lie more than ``sigma`` standard deviations above the mean.

    Two passes are in the nature of it: the mean comes first.  The series is written once to the shared folder, so that
    the sums over channels are not computed again for the second.
    """
    spark = series.sparkSession
    path = shared_path(spark, "series")
    series.write.parquet(path)
    series = spark.read.schema(series.schema).parquet(path)
    v = F.col(value).cast("double")
    both = series.agg(F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))).scalar()
    marked = series.withColumn("_s", both)
    high = marked.where(v - F.col("_s.mean") > F.lit(sigma) * F.col("_s.std"))
    return high.withColumn("snr", (v - F.col("_s.mean")) / F.col("_s.std")).drop("_s").orderBy("dm_idx", "t").limit(limit)


def best_trial(series: DataFrame, value: str = "value") -> DataFrame:
    """The sample with the largest value of every trial (ties: the earliest)."""
    order = F.struct(F.col(value), -F.col("t"))
    return series.groupBy("dm_idx", "dm").agg(F.max_by("t", order).alias("t"), F.max(value).alias("peak"))


def head_even(series: DataFrame, count: int) -> DataFrame:
    """The first ``count`` samples of each trial, one less where that is odd."""
    return series.where(F.col("t") < count - count % 2)


def inject_pulse(long: DataFrame, spec: ObservationSpec, dm: float, at: int, amplitude: int, top: int = 255) -> DataFrame:
    """(t, ch, v) with ``amplitude`` added where a pulse of that dispersion, at sample ``at`` in the first channel, passes."""
    path = shift_matrix(long.sparkSession, spec, [dm]).select("ch", (F.col("shift") + at).alias("hit"))
    v = F.when(F.col("t") == F.col("hit"), F.least(F.col("v") + amplitude, F.lit(top))).otherwise(F.col("v"))
    return long.join(F.broadcast(path), "ch").select("t", "ch", v.cast("int").alias("v"))


def noise(spark, spec: ObservationSpec, nsamps: int, rms: float, seed: int = 0) -> DataFrame:
    """(t, ch, v): normal noise as bytes; the same for a seed and a number of partitions."""
    n = spec.nchans
    x = F.randn(seed) * F.lit(rms)
    v = F.least(F.greatest(F.floor(x + 128.0), F.lit(0)), F.lit(255)).cast("int")
    return spark.range(0, nsamps * n).select(F.expr(f"id div {n}").alias("t"), (F.col("id") % n).cast("int").alias("ch"), v.alias("v"))


def sine(spark, spec: ObservationSpec, nsamps: int) -> DataFrame:
    """(t, ch, x): sin(pi t dt) in every channel."""
    n = spec.nchans
    rows = spark.range(0, nsamps * n).select(F.expr(f"id div {n}").alias("t"), (F.col("id") % n).cast("int").alias("ch"))
    return rows.withColumn("x", F.sin(F.pi() * F.col("t") * flt(spec.dt).cast("double")))


def counting(spark, nchans: int, nsamps: int, nbits: int = 8) -> DataFrame:
    """(t, ch, v): a fixed pattern for timing runs."""
    top = (1 << nbits) - 1
    return spark.range(0, nsamps * nchans).select(F.expr(f"id div {nchans}").alias("t"), (F.col("id") % nchans).cast("int").alias("ch"), F.pmod(F.col("id") * 7919, F.lit(top + 1)).cast("int").alias("v"))


def counting_wide(spark, nchans: int, nsamps: int, nbits: int = 8) -> DataFrame:
    """(t, v array) of the same kind of pattern."""
    top = (1 << nbits) - 1
    ch = F.sequence(F.lit(0), F.lit(nchans - 1))
    return spark.range(0, nsamps).select(F.col("id").alias("t"), F.transform(ch, lambda c: (c * 7919 + F.col("id") * 104729).bitwiseAND(top).cast("int")).alias("v"))


def decimate(long: DataFrame, factor: int, nsamps: int) -> DataFrame:
    """(t, ch, v): whole mean of each ``factor`` samples of a channel; an incomplete group at the end is left out."""
    group = F.expr(f"t div {factor}")
    whole = long.where(F.col("t") < nsamps // factor * factor)
    return whole.groupBy(group.alias("t"), "ch").agg(F.floor(F.sum("v") / factor).cast("int").alias("v"))


def throughput(nsamps_out: int, nsamps_in: int, nchans: int, ndm: int, seconds: float, samples_per_thread: int = 2) -> dict[str, float]:
    """Operations of a search by stage, and billions of them a second."""
    sums = nsamps_out * nchans * ndm * (2 + 1 / samples_per_thread)
    before = 5.0 * nsamps_in * nchans
    return {"preprocessing": before, "summing": sums, "gops": (before + sums) / seconds / 1e9}
