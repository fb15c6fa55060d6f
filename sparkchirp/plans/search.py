"""A search plan: an observation, its trials and how to run them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fourier, timedomain
from ..operators.detect import throughput
from ..spec import GULP_SIZE, IN_NBITS, OUT_NBITS, Code, Flag, ObservationSpec, SearchError, adaptive_dms, f32
from .shipping import shared_path

METHODS = ("relational", "time", "fourier", "auto")
RELATIONAL_CELLS = 1 << 25  # samples times channels times trials that ``auto`` leaves to the relational form


class SearchPlan:
    """Holds what a search needs; ``execute`` gives a lazy DataFrame (dm_idx, dm, t, value).

    ``method`` is ``relational`` (a row for each sample, channel and trial: short data), ``time`` (kernels on blocks),
    ``auto`` (one of these two, by size) or ``fourier``.
    """

    def __init__(self, spark: SparkSession, nchans: int, dt: float, f0: float, df: float, method: str = "time"):
        if method not in METHODS:
            raise SearchError(Code.INVALID_PLAN)
        self.spark, self.method = spark, method
        self.spec = ObservationSpec(nchans, dt, f0, df)
        self.dms: list[float] = []
        self._gulp = GULP_SIZE

    # trials and mask
    def set_dm_list(self, dms) -> None:
        if dms is None:
            raise SearchError(Code.INVALID_POINTER)
        dms = [f32(x) for x in dms]
        if any(b < a for a, b in zip(dms, dms[1:], strict=False)):
            raise SearchError(Code.INVALID_PLAN)
        self.dms = dms

    def generate_dm_list(self, start: float, end: float, pulse_width: float, tol: float) -> None:
        self.dms = adaptive_dms(self.spec, start, end, pulse_width, tol)

    def set_killmask(self, mask) -> None:
        """0 leaves a channel out; None brings all back."""
        self.spec = self.spec.with_killmask(mask)

    # gulps: not for the frequency domain
    @property
    def gulp_size(self) -> int:
        self._needs_gulps()
        return self._gulp

    @gulp_size.setter
    def gulp_size(self, samples: int) -> None:
        self._needs_gulps()
        self._gulp = int(samples)

    def _needs_gulps(self) -> None:
        if self.method == "fourier":
            raise SearchError(Code.INVALID_PLAN)

    # what is known
    @property
    def channel_count(self) -> int:
        return self.spec.nchans

    @property
    def dm_count(self) -> int:
        return len(self.dms)

    @property
    def dm_list(self) -> list[float]:
        return list(self.dms)

    @property
    def delay_table(self) -> list[float]:
        return [float(x) for x in self.spec.delays()]

    @property
    def killmask(self) -> list[int]:
        return list(self.spec.killmask)

    @property
    def dt(self) -> float:
        return self.spec.dt

    @property
    def f0(self) -> float:
        return self.spec.f0

    @property
    def df(self) -> float:
        return self.spec.df

    @property
    def max_delay(self) -> int:
        return self.spec.max_delay(self.dms)

    def dm_delay(self, trial: int) -> int:
        return self.spec.dm_delay(self.dms, trial)

    # running
    def validate(self, wide, nsamps: int, in_nbits: int, out_nbits: int, flags: int, in_stride: int | None, out_stride: int | None) -> None:
        """Raise for the first wrong argument, in a fixed order."""
        if wide is None:
            raise SearchError(Code.INVALID_POINTER)
        if self.dms and nsamps < self.max_delay:
            raise SearchError(Code.TOO_FEW_NSAMPS)
        if in_stride is not None and in_stride < self.spec.nchans * in_nbits // 8:
            raise SearchError(Code.INVALID_STRIDE)
        if out_stride is not None and self.dms and out_stride < (nsamps - self.max_delay) * (out_nbits // 8):
            raise SearchError(Code.INVALID_STRIDE)
        if not self.dms:
            raise SearchError(Code.NO_DM_LIST_SET)
        flags = Flag(flags)
        if (Flag.HOST_POINTERS in flags and Flag.DEVICE_POINTERS in flags) or (Flag.WAIT in flags and Flag.ASYNC in flags):
            raise SearchError(Code.INVALID_FLAG_COMBINATION)
        if in_nbits not in IN_NBITS:
            raise SearchError(Code.UNSUPPORTED_IN_NBITS)
        if out_nbits not in OUT_NBITS:
            raise SearchError(Code.UNSUPPORTED_OUT_NBITS)

    def execute(
        self,
        wide: DataFrame,
        nsamps: int | None = None,
        in_nbits: int = 8,
        out_nbits: int = 32,
        flags: int = Flag.DEFAULT,
        first_dm_idx: int = 0,
        dm_count: int | None = None,
        in_stride: int | None = None,
        out_stride: int | None = None,
        **options,
    ) -> DataFrame:
        """The series of the trials from ``first_dm_idx`` on, over spectra (t, v)."""
        if nsamps is None and wide is not None:
            nsamps = int(wide.agg(F.coalesce(F.max("t") + 1, F.lit(0))).first()[0])
        self.validate(wide, nsamps, in_nbits, out_nbits, flags, in_stride, out_stride)
        if self.method == "fourier":
            # values are centred means, no sums of samples: of the output depths they take the 32-bit one
            if out_nbits != 32:
                raise SearchError(Code.UNSUPPORTED_OUT_NBITS)
            return fourier.sums_fourier(wide, self.spec, self.dms, nsamps, first=first_dm_idx, count=dm_count, **options)
        cells = nsamps * self.spec.nchans * (len(self.dms) if dm_count is None else dm_count)
        if self.method == "relational" or (self.method == "auto" and cells <= RELATIONAL_CELLS):
            sums = timedomain.sums_relational(timedomain.to_long(wide), self.spec, self.dms, nsamps, first_dm_idx, dm_count)
        else:
            sums = timedomain.sums_blocks(wide, self.spec, self.dms, nsamps, self._gulp, first=first_dm_idx, count=dm_count, **options)
        return timedomain.scaled(sums, self.spec, in_nbits, out_nbits).select("dm_idx", "dm", "t", "value")

    @staticmethod
    def sync(df: DataFrame) -> int:
        """Run a result to its end; the number of its rows."""
        return df.count()

    def measure(self, wide: DataFrame, nsamps: int, **arguments) -> tuple[DataFrame, dict[str, float]]:
        """The series, written to the shared folder, and seconds and operations of the run (as ``throughput`` counts them)."""
        begin, path = time.perf_counter(), shared_path(self.spark, "series")
        series = self.execute(wide, nsamps, **arguments)
        series.write.parquet(path)
        seconds = time.perf_counter() - begin
        figures = throughput(nsamps - self.max_delay, nsamps, self.spec.nchans, self.dm_count, seconds)
        return self.spark.read.schema(series.schema).parquet(path), {"seconds": seconds} | figures
