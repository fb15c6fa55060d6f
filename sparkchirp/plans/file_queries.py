"""Named queries over file sources and sinks: ``embeddings`` written to the shared folder in each format and read back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import pack, unpack
from ..operators import detect, timedomain
from ..sources import benchlog, outputs, subints
from ..sources.filterbank import Header, read_filterbank, read_header, read_raw, write_filterbank, write_raw
from ..spec import ObservationSpec
from .catalogue import DELAYS, DMS, FB, SPEC, TS, _samples, _sums, filterbank, scale_sql, sums_sql
from .shipping import shared_path

HEAD = Header(tsamp=6.4e-3, tstart=55000.25, fch1=1581.0, foff=-6.25, nchans=64, nbits=8, telescope_id=4, machine_id=10, source_name="J0000-0000")
PART = 300  # samples a file
LAYOUT = subints.Layout(nchans=64, pols=2, spectra=128, rows=1, header=64, gap=12)
ADD = lambda a, v: a + v


def _written(spark: SparkSession, sf_dir: str, nbits: int = 8) -> list:
    """One row a file: a few paths reach the driver."""
    wide = filterbank(spark, sf_dir).select("t", F.transform("v", lambda v: F.shiftright(v, 8 - nbits)).alias("v"))
    return write_filterbank(wide, Header(**HEAD.__dict__ | {"nbits": nbits}), shared_path(spark, "fil"), PART).orderBy("part").collect()


def _read_back(spark: SparkSession, parts: list) -> DataFrame:
    out = None
    for p in parts:
        one = read_filterbank(spark, p.path, samples=128).select((F.col("t") + p.part * PART).alias("t"), F.col("v").cast("array<bigint>").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def headers(spark, sf_dir):
    rows = []
    for p in _written(spark, sf_dir):
        h, _, samples = read_header(p.path)
        rows.append((p.part, samples, h.nsamples, h.nchans, h.nbits, h.tsamp, h.fch1, h.foff, round(h.tstart, 9), h.source_name))
    return spark.createDataFrame(rows, "part int, samples long, nsamples long, nchans int, nbits int, tsamp double, fch1 double, foff double, tstart double, source string")


def scan(nbits: int):
    def query(spark, sf_dir):
        return timedomain.to_long(_read_back(spark, _written(spark, sf_dir, nbits)))

    return query


def strided(spark, sf_dir):
    """Raw files whose spectra lie 80 bytes apart."""
    parts = write_raw(filterbank(spark, sf_dir), 8, shared_path(spark, "raw"), stride=80, samples=PART).orderBy("part").collect()
    out = None
    for p in parts:
        one = read_raw(spark, p.path, 64, 8, stride=80, samples=128).select((F.col("t") + p.part * PART).alias("t"), F.aggregate("v", F.lit(0).cast("bigint"), ADD).alias("sum"))
        out = one if out is None else out.unionByName(one)
    return out


def strided_rows(spark, sf_dir):
    """Packed spectra with bytes beyond the row, unpacked by stride."""
    raw = pack(filterbank(spark, sf_dir), 8).select("t", F.concat("raw", F.unhex(F.lit("FF" * 16))).alias("raw"))
    return unpack(raw, 8, 64, stride=80).select("t", F.aggregate("v", F.lit(0).cast("bigint"), ADD).alias("sum"))


def recording(spark, sf_dir):
    """A calibrated recording of two polarisations, the second one the filterbank."""
    wide = filterbank(spark, sf_dir)
    n, rows = _samples(wide), -(-_samples(wide) // LAYOUT.spectra)
    ch = np.arange(64)
    weights, offsets, scales = (ch % 3).astype(float), np.concatenate([ch * 0.0, ch * 0.25]), np.concatenate([ch * 0.0 + 9, ch * 0.5])

    def work(table: pa.Table) -> pa.Table:
        i = table.column("subint")[0].as_py()
        data = np.zeros((LAYOUT.spectra, 2, 64), np.uint8)
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(-1, 64)
        data[np.asarray(table.column("t")) - i * LAYOUT.spectra, 1] = v
        lists = [pa.array([x.tolist()], pa.list_(pa.float32())) for x in (weights, offsets, scales)]
        return pa.table([pa.array([i], pa.int32()), *lists, pa.array([data.tobytes()], pa.binary())], names=["subint", "wts", "offs", "scl", "data"])

    subint = F.floor(F.col("t") / LAYOUT.spectra).cast("int").alias("subint")
    table = wide.select(subint, "t", "v").groupBy("subint").applyInArrow(work, "subint int, wts array<float>, offs array<float>, scl array<float>, data binary")
    path = shared_path(spark, "recording") + "/rec.bin"
    subints.write_subints(table, path, LAYOUT).collect()
    layout = subints.Layout(**LAYOUT.__dict__ | {"rows": rows})
    return timedomain.to_long(subints.calibrated(subints.read_subints(spark, path, layout), layout, pol=1).where(F.col("t") < n)).withColumnRenamed("v", "x")


def _series_files(spark, sf_dir) -> tuple[str, DataFrame]:
    folder = shared_path(spark, "series-files")
    series = timedomain.scaled(_sums(spark, sf_dir), SPEC, 8, 32)
    return folder, outputs.write_series(series, HEAD, folder, "obs")


def dat_files(spark, sf_dir):
    """The series files of all trials, read back as floats."""
    folder, done = _series_files(spark, sf_dir)
    done.collect()

    def work(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(content, "<f4")
                name = path.rpartition("/")[2].removesuffix(".dat")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x))), pa.array(x)], names=["name", "t", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dat").load(folder).select("path", "content")
    return files.mapInArrow(work, "name string, t bigint, value float")


def inf_files(spark, sf_dir):
    """The lines of all information files that differ from trial to trial."""
    folder, done = _series_files(spark, sf_dir)
    done.collect()
    lines = spark.read.option("pathGlobFilter", "*.inf").text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.inf$", 1).alias("name"), F.col("value").alias("line"))
    return lines.where(F.col("line").rlike("^ (Data file name|Dispersion measure|Number of bins|Telescope used|Instrument used|Epoch)"))


def parquet_by_trial(spark, sf_dir):
    path = shared_path(spark, "by-trial")
    outputs.write_table(_sums(spark, sf_dir), path, "dm_idx")
    return spark.read.schema("dm float, t bigint, sum bigint, dm_idx int").parquet(path).select("dm_idx", "dm", "t", "sum")


def perf_log(spark, sf_dir):
    """Seconds of each type of event as a timing table, written and read back."""
    path = shared_path(spark, "perf")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy("event_type").collect()
    outputs.write_timings(spark, [(r.n / 4, r.n / 8, r.n / 2, float(r.n)) for r in rows], path)
    return spark.read.option("sep", "\t").schema("input double, output double, summing double, total double").csv(path)


def _log_files(spark, sf_dir) -> DataFrame:
    """A log file for each type of event and day of the week, its values as run times."""
    folder = shared_path(spark, "logs")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.element_at(F.array(*[F.lit(f"{x:<20}: ") for x in ("Runtime", "Total time", "Uptime")]), (F.col("event_id") % 3 + 1).cast("int")), F.format_string("%.2f", F.round("value", 2)), F.lit(" sec."))
    e.select(F.concat(F.lit("nchan_"), "event_type").alias("test"), line.alias("line")).write.partitionBy("test").text(folder)
    files = spark.read.text(folder).select("test", F.col("value").alias("line"))
    return benchlog.timings(files)


def log_table(spark, sf_dir):
    """The means of every label by test; a column of each label, in their order."""
    table = benchlog.mean_table(_log_files(spark, sf_dir))
    return table.select("test", "sort_by", *[F.round(F.col(f"`{x}`"), 6).alias(x.replace(" ", "_").lower()) for x in benchlog.LABELS])


def noise_check(spark, sf_dir):
    """Normal noise as bytes: the counts and moments that any seed must give."""
    x = detect.noise(spark, SPEC, 2000, 20.0, seed=5)
    stats = x.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.countDistinct("ch").alias("channels"))
    good = (F.col("lo") >= 0) & (F.col("hi") <= 255) & (F.abs(F.col("mean") - 127.5) < 1) & (F.abs(F.col("std") - 20.0) < 1)
    return stats.select("n", "channels", good.alias("as_asked"))


QUERIES = {
    "fil_headers": headers,
    "fil_scan": scan(8),
    "fil_scan_2": scan(2),
    "raw_strided": strided,
    "strided_rows": strided_rows,
    "subints_calibrated": recording,
    "dat_files": dat_files,
    "inf_files": inf_files,
    "parquet_by_trial": parquet_by_trial,
    "perf_log": perf_log,
    "bench_log_table": log_table,
    "noise": noise_check,
    "sine": lambda s, d: detect.sine(s, SPEC, 200).select("t", "ch", F.round("x", 9).alias("x")),
    "bench_pattern": lambda s, d: detect.counting(s, 64, 300),
    "bench_pattern_wide": lambda s, d: timedomain.to_long(detect.counting_wide(s, ObservationSpec(64, 6.4e-3, 1581.0, -6.25).nchans, 300, 4)),
}

_SUM = f"WITH {FB} SELECT t, sum(v)::BIGINT AS sum FROM fb GROUP BY t"
_NULLS = ", ".join(f"NULL::DOUBLE AS {x.replace(' ', '_').lower()}" for x in benchlog.LABELS if x not in ("Runtime", "Total time"))

SQL = {
    "fil_headers": f"""
        WITH n AS (SELECT count(*) AS n FROM embeddings)
        SELECT part::INTEGER AS part, least({PART}, n - part * {PART}) AS samples, least({PART}, n - part * {PART}) AS nsamples, 64 AS nchans, 8 AS nbits, 0.0064::DOUBLE AS tsamp, 1581.0::DOUBLE AS fch1,
               -6.25::DOUBLE AS foff, round(55000.25::DOUBLE + part * {PART} * 0.0064::DOUBLE / 86400, 9) AS tstart, 'J0000-0000' AS source
        FROM n, range((SELECT (count(*) + {PART} - 1) // {PART} FROM embeddings)) r(part)""",
    "fil_scan": f"WITH {FB} SELECT t, ch, v::BIGINT AS v FROM fb",
    "fil_scan_2": f"WITH {FB} SELECT t, ch, (v >> 6)::BIGINT AS v FROM fb",
    "raw_strided": _SUM,
    "strided_rows": _SUM,
    "subints_calibrated": f"WITH {FB} SELECT t, ch, ((v::FLOAT * (ch * 0.5)::FLOAT + (ch * 0.25)::FLOAT) * (ch % 3)::FLOAT)::FLOAT AS x FROM fb",
    "dat_files": f"""
        WITH {sums_sql()}, e AS (SELECT *, (n - maxd) - (n - maxd) % 2 AS even FROM n, maxd)
        SELECT printf('obs_DM%.3f', dm) AS name, t, ({scale_sql('1')})::FLOAT AS value FROM ts, e WHERE t < even""",
    "inf_files": f"""
        WITH n AS (SELECT count(*) AS n FROM embeddings), {DELAYS}
        SELECT printf('obs_DM%.3f', dm) AS name, replace(replace(replace(x, '#name', printf('obs_DM%.3f', dm)), '#dm', dm::BIGINT::VARCHAR), '#n', ((n - maxd) - (n - maxd) % 2)::VARCHAR) AS line
        FROM dms, n, maxd, (VALUES (' Data file name without suffix          =  #name'), (' Dispersion measure (cm-3 pc)           =  #dm'), (' Number of bins in the time series      =  #n'),
             (' Telescope used                         =  Parkes'), (' Instrument used                        =  ARTEMIS'), (' Epoch of observation (MJD)             =  55000.250000000000000')) AS v(x)""",
    "parquet_by_trial": TS,
    "perf_log": 'SELECT count(*) / 4 AS "input", count(*) / 8 AS "output", count(*) / 2 AS summing, count(*)::DOUBLE AS total FROM events GROUP BY event_type',
    "bench_log_table": f"""
        WITH lines AS (SELECT 'nchan_' || event_type AS test, event_id % 3 AS k, printf('%.2f', round(value, 2))::DOUBLE AS s FROM events)
        SELECT test, ':' || replace(test[7:], '_', ':') AS sort_by, round(avg(s) FILTER (k = 0), 6) AS runtime, round(avg(s) FILTER (k = 1), 6) AS total_time, {_NULLS} FROM lines GROUP BY test""",
    "noise": "SELECT 128000::BIGINT AS n, 64::BIGINT AS channels, true AS as_asked",
    "sine": "SELECT t, ch::INTEGER AS ch, round(sin(pi() * t * 0.0064::FLOAT::DOUBLE), 9) AS x FROM range(200) a(t), range(64) b(ch)",
    "bench_pattern": "SELECT t, ch::INTEGER AS ch, (((t * 64 + ch) * 7919) % 256)::INTEGER AS v FROM range(300) a(t), range(64) b(ch)",
    "bench_pattern_wide": "SELECT t, ch::INTEGER AS ch, ((ch * 7919 + t * 104729) & 15)::INTEGER AS v FROM range(300) a(t), range(64) b(ch)",
}
