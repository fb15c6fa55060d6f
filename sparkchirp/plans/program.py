"""Whole programs: search a filterbank file trial by trial, and time a search over generated data.

    python -m sparkchirp.plans.program -f obs.fil -r 900 -s 1 -n 100 -o out/pre
"""

from __future__ import annotations

import argparse
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..operators.decimate import decimate_wide
from ..operators.detect import counting_wide, throughput
from ..sources.filterbank import Header, read_filterbank, read_header
from ..sources.outputs import write_series
from ..spec import Code, SearchError, linear_dms
from .search import SearchPlan


def search_file(
    spark: SparkSession,
    path: str,
    prefix: str,
    start: float = 0.0,
    end: float = 50.0,
    step: float | None = None,
    trials: int | None = None,
    decimate: int = 1,
    samples: int | None = None,
    pulse_width: float = 4.0,
    tolerance: float = 1.25,
    method: str = "time",
) -> DataFrame:
    """Search a file and write a series and an information file for each trial; gives (dm_idx, path, samples).

    Trials are linear where a step is given, up to ``end`` or ``trials`` of them; otherwise spaced by the tolerance.
    """
    header, _, nsamps = read_header(path)
    if header.nifs != 1:
        raise SearchError(Code.INVALID_PLAN)
    wide = read_filterbank(spark, path)
    if decimate > 1:
        wide = decimate_wide(wide, decimate, nsamps)
        header, nsamps = Header(**asdict(header) | {"tsamp": header.tsamp * decimate}), nsamps // decimate
    plan = SearchPlan(spark, header.nchans, header.tsamp, header.fch1, header.foff, method)
    if step:
        plan.set_dm_list(linear_dms(start, step, trials, end))
    else:
        plan.generate_dm_list(start, end, pulse_width, tolerance)
    series = plan.execute(wide, nsamps, header.nbits, 32)
    folder, _, stem = prefix.rpartition("/")
    return write_series(series, header, folder or ".", stem, samples)


def time_search(
    spark: SparkSession, nchans: int = 1024, nsamps: int = 120_000, trials: int = 100, start: float = 0.0, step: float = 2.0, dt: float = 64e-6, f0: float = 1581.0, band: float = 400.0, iterations: int = 1, method: str = "time"
) -> list[dict]:
    """Times of a search over a generated pattern: one row an iteration with seconds and billions of operations a second."""
    plan = SearchPlan(spark, nchans, dt, f0, -band / nchans, method)
    plan.set_dm_list(linear_dms(start, step, trials))
    wide = counting_wide(spark, nchans, nsamps)
    out = []
    for i in range(iterations):
        begin = time.perf_counter()
        plan.execute(wide, nsamps).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - begin
        out.append({"iteration": i, "seconds": seconds, "max_delay": plan.max_delay, "computed": nsamps - plan.max_delay} | throughput(nsamps - plan.max_delay, nsamps, nchans, trials, seconds))
    return out


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-f", dest="path", required=True, help="filterbank file")
    p.add_argument("-o", dest="prefix", required=True, help="output prefix")
    p.add_argument("-r", dest="range", default="0,50", help="first and optionally last dispersion measure")
    p.add_argument("-s", dest="step", type=float, help="linear step (default: trials by tolerance)")
    p.add_argument("-n", dest="trials", type=int, help="number of trials")
    p.add_argument("-d", dest="decimate", type=int, default=1, help="decimation factor")
    p.add_argument("-N", dest="samples", type=int, help="samples to write (default: all)")
    p.add_argument("-w", dest="width", type=float, default=4.0, help="pulse width in microseconds")
    p.add_argument("-t", dest="tolerance", type=float, default=1.25, help="smearing tolerance between trials")
    p.add_argument("-m", dest="method", default="time", help="relational, time or fourier")
    p.add_argument("-q", dest="quiet", action="store_true")
    a = p.parse_args(arguments)
    first, _, last = a.range.partition(",")
    spark = SparkSession.builder.getOrCreate()
    done = search_file(spark, a.path, a.prefix, float(first), float(last or 50.0), a.step, a.trials, a.decimate, a.samples, a.width, a.tolerance, a.method).orderBy("dm_idx").collect()
    if not a.quiet:
        for r in done:
            print(f"{r.path}: {r.samples} samples")


if __name__ == "__main__":
    main()
