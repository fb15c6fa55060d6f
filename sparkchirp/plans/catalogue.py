"""Named queries over the driver's tables and the SQL that gives the same rows.

The filterbank is ``embeddings``: vec_id is the sample, the array position the channel, quantised to bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, numeric
from ..functions.codec import expand, rescale
from ..operators import detect, fourier, tables, timedomain
from ..operators.decimate import decimate_wide
from ..sources import benchlog
from ..sources.outputs import inf_table
from ..spec import MESSAGES, ObservationSpec, adaptive_dms, linear_dms
from ..streaming.sums import stream_to_table

SPEC = ObservationSpec(64, 6.4e-3, 1581.0, -6.25)
DMS = linear_dms(0.0, 50.0, 20)
ADAPTIVE = ObservationSpec(1024, 250e-6, 1581.0, -100.0 / 1024)
KILLED = tuple(int(ch % 5 != 3) for ch in range(64))
GULP = 97


# --------------------------------------------------------------------------- inputs
def filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, v array): the embeddings as bytes."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("t"), "embedding")
    return x.select("t", F.transform("embedding", lambda e: numeric.quantise(e * numeric.flt(25.0) * numeric.flt(4.0))).alias("v"))


def _samples(wide: DataFrame) -> int:
    return wide.count()


def _sums(spark, sf_dir, spec=SPEC, **more) -> DataFrame:
    wide = filterbank(spark, sf_dir)
    return timedomain.sums_relational(timedomain.to_long(wide), spec, DMS, _samples(wide), **more)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, word): a 32-bit word of every event."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296)).alias("word"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, ch, x): the embeddings before quantising."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return x.select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("ch", "x"))


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.inject_pulse(timedomain.to_long(filterbank(spark, sf_dir)), SPEC, 400.0, 50, 60)


# --------------------------------------------------------------------------- queries
def scaled_query(out_nbits: int):
    def query(spark, sf_dir):
        return timedomain.scaled(_sums(spark, sf_dir), SPEC, 8, out_nbits).drop("sum")

    return query


def unpack_query(nbits: int):
    def query(spark, sf_dir):
        return _words(spark, sf_dir).select("id", F.posexplode(expand(F.col("word"), nbits)).alias("k", "v"))

    return query


def fourier_query(segment):
    def query(spark, sf_dir):
        wide = filterbank(spark, sf_dir)
        out = fourier.sums_fourier(wide, SPEC, DMS, _samples(wide), segment=segment)
        return out.withColumn("value", F.round("value", 7) + F.lit(0.0))

    return query


def spectrum_query(spark, sf_dir):
    """Back from the spectra by the inverse transform."""
    wide = filterbank(spark, sf_dir)
    n = _samples(wide)
    nfft = numeric.round_up(n + SPEC.max_delay(DMS), 1024)
    spectrum = fourier.spectra_fourier(wide, SPEC, DMS, n, nfft)
    back = fourier.series_from_spectra(spectrum, nfft, timedomain.output_samples(n, SPEC.max_delay(DMS)))
    return back.withColumn("value", F.round("value", 7) + F.lit(0.0))


def blocks_query(spark, sf_dir):
    wide = filterbank(spark, sf_dir)
    return timedomain.sums_blocks(wide, SPEC, DMS, _samples(wide))


def gulps_query(spark, sf_dir):
    wide = filterbank(spark, sf_dir)
    return timedomain.sums_blocks(wide, SPEC, DMS, _samples(wide), gulp=GULP, dm_block=7)


def packed_query(spark, sf_dir):
    """Spectra packed at 4 bits, unpacked again and summed over channels."""
    from ..functions.codec import pack, unpack

    wide = filterbank(spark, sf_dir).select("t", F.transform("v", lambda v: F.shiftright(v, 4)).alias("v"))
    return unpack(pack(wide, 4), 4, SPEC.nchans).select("t", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("sum"))


def subband_query(spark, sf_dir):
    wide = filterbank(spark, sf_dir)
    return timedomain.sums_subbands(timedomain.to_long(wide), SPEC, DMS, _samples(wide), 8).drop("dm")


def coarse_query(spark, sf_dir):
    """Spectra joined two by two, then summed."""
    wide = filterbank(spark, sf_dir)
    n = _samples(wide)
    return decimate_wide(wide, 2, n).select("t", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("sum"))


def zero_query(spark, sf_dir):
    wide = filterbank(spark, sf_dir)
    return timedomain.sums_relational(timedomain.to_long(wide), SPEC, [0.0], _samples(wide)).drop("dm_idx", "dm")


def peaks_query(spark, sf_dir):
    long = _injected(spark, sf_dir)
    n = _samples(filterbank(spark, sf_dir))
    sums = timedomain.sums_relational(long, SPEC, DMS, n)
    found = detect.peaks(sums, 3.0, 101, "sum")
    return found.select("dm_idx", "t", "sum", F.round("snr", 6).alias("snr"))


def best_query(spark, sf_dir):
    long = _injected(spark, sf_dir)
    n = _samples(filterbank(spark, sf_dir))
    return detect.best_trial(timedomain.sums_relational(long, SPEC, DMS, n), "sum").drop("dm")


def affine_query(spark, sf_dir):
    raw = _raw(spark, sf_dir).withColumn("x", F.col("x").cast("double"))
    slope, intercept = numeric.affine_range(raw, "x")
    return raw.select("t", "ch", numeric.quantise_affine(F.col("x"), slope, intercept).alias("v"))


def rounded_statistics(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def inf_query(spark, sf_dir):
    return inf_table(spark, DMS, "obs", 100)


def stream_query(spark, sf_dir):
    return stream_to_table(spark, f"{sf_dir}/embeddings.parquet*", SPEC, DMS)


QUERIES = {
    "delay_table": lambda s, d: tables.delay_table(s, SPEC),
    "dm_linear": lambda s, d: tables.linear_dm_table(s, 0.0, 50.0, 20),
    "dm_explicit": lambda s, d: tables.dm_table(s, [0.5, 2.25, 10.0, 33.3]),
    "dm_adaptive": lambda s, d: tables.dm_table(s, adaptive_dms(ADAPTIVE, 2.0, 100.0, 4.0, 1.25)),
    "max_delay": lambda s, d: tables.max_delay_table(s, SPEC, DMS),
    "dm_delay": lambda s, d: tables.dm_delay_table(s, SPEC, DMS),
    "smearing": lambda s, d: tables.dm_table(s, DMS).select("dm_idx", F.round(numeric.smearing(F.col("dm"), F.lit(50.0), 6.4e-3, 4e-3, 1581.0, -6.25, 64), 6).alias("smear")),
    "killmask": lambda s, d: tables.killmask_table(s, SPEC.with_killmask(KILLED)),
    "shift_matrix": lambda s, d: tables.shift_matrix(s, SPEC, DMS),
    "spin_table": lambda s, d: tables.spin_table(s, 6.4e-3, 2048),
    "chunk_table": lambda s, d: tables.segment_table(s, 100000, 4063),
    "chunk_spin_table": lambda s, d: tables.segment_spin_table(s, 6.4e-3, 4000, 150, 512),
    "fb_long": lambda s, d: timedomain.to_long(filterbank(s, d)),
    "quantize_clamp": lambda s, d: _raw(s, d).select("t", "ch", numeric.quantise(F.col("x"), numeric.flt(400.0)).alias("v")),
    "quantize_affine": affine_query,
    "centre_scale": lambda s, d: timedomain.to_long(filterbank(s, d)).select("t", "ch", F.round(numeric.centre(F.col("v"), 64), 9).alias("x")),
    "calibrate": lambda s, d: _raw(s, d).select("t", "ch", numeric.calibrate(F.floor(F.col("x") * 100), F.col("ch") * numeric.flt(0.5), numeric.flt(3.0), numeric.flt(0.25)).alias("x")),
    **{f"unpack_{n}": unpack_query(n) for n in (1, 2, 4, 8, 16, 32)},
    "expand_4_to_8": lambda s, d: unpack_query(4)(s, d).select("id", "k", rescale(F.col("v"), 4, 8).alias("v")),
    "pack_round_trip": packed_query,
    "transpose_channel_major": lambda s, d: timedomain.channel_major(timedomain.to_long(filterbank(s, d))).select("ch", F.concat_ws(",", F.col("v").cast("array<string>")).alias("v")),
    "tdd_sum": lambda s, d: _sums(s, d),
    "tdd_f32": scaled_query(32),
    "tdd_u8": scaled_query(8),
    "tdd_u16": scaled_query(16),
    "tdd_killmask": lambda s, d: _sums(s, d, SPEC.with_killmask(KILLED)),
    "tdd_all_killed": lambda s, d: _sums(s, d, SPEC.with_killmask([0] * 64)),
    "tdd_dm_range": lambda s, d: _sums(s, d, first=5, count=4),
    "tdd_head_n": lambda s, d: detect.head_even(_sums(s, d), 51),
    "tdd_blocks": blocks_query,
    "tdd_gulped": gulps_query,
    "tdd_subbands": subband_query,
    "tdd_subbands_added": lambda s, d: timedomain.add_subbands(timedomain.sums_subbands(timedomain.to_long(filterbank(s, d)), SPEC, DMS, _samples(filterbank(s, d)), 5)),
    "tdd_zero_dm": zero_query,
    "decimate_wide_2": coarse_query,
    "decimate_4": lambda s, d: detect.decimate(timedomain.to_long(filterbank(s, d)), 4, _samples(filterbank(s, d))),
    "channel_stats": lambda s, d: rounded_statistics(detect.statistics(timedomain.to_long(filterbank(s, d)), ["ch"], "v")),
    "global_stats": lambda s, d: rounded_statistics(detect.statistics(timedomain.to_long(filterbank(s, d)), None, "v")),
    "inject_pulse": _injected,
    "detect_peaks": peaks_query,
    "best_dm": best_query,
    "fdd_time": fourier_query(None),
    "fdd_segmented": fourier_query(256),
    "fdd_spectrum": spectrum_query,
    "telescope_names": lambda s, d: s.range(0, 17, 1, 1).select(F.col("id").cast("int").alias("id"), names.telescope_name(F.col("id")).alias("name")),
    "backend_names": lambda s, d: s.range(0, 13, 1, 1).select(F.col("id").cast("int").alias("id"), names.backend_name(F.col("id")).alias("name")),
    "error_strings": lambda s, d: s.range(0, 18, 1, 1).select(F.col("id").cast("int").alias("code"), names.error_string(F.col("id")).alias("message")),
    "sexagesimal": lambda s, d: s.range(0, 100, 1, 1).select("id", *[c.alias(n) for c, n in zip(numeric.sexagesimal(F.col("id") * 1234.5), ("first", "minutes", "seconds"), strict=True)]),
    "inf_header": inf_query,
    "bench_log_stats": benchlog.events_query,
    "stream_tdd": stream_query,
    "stream_tdd_bands": lambda s, d: stream_to_table(s, f"{d}/embeddings.parquet*", SPEC, DMS, 5),
}

# --------------------------------------------------------------------------- SQL
FB = """
    fb AS (SELECT vec_id AS t, (i - 1)::INTEGER AS ch, x,
                  least(greatest(floor((x * 25::FLOAT * 4::FLOAT + 127.5::FLOAT)::DOUBLE + 0.5::DOUBLE), 0), 255)::INTEGER AS v
           FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
    n AS (SELECT count(*) AS n FROM embeddings)"""
DELAYS = """
    inv AS (SELECT range::INTEGER AS ch, (1581.0::FLOAT + range::FLOAT * (-6.25)::FLOAT) AS freq,
                   (1.0::DOUBLE / (1581.0::FLOAT + range::FLOAT * (-6.25)::FLOAT)::DOUBLE)::FLOAT AS a,
                   (1.0::DOUBLE / 1581.0::FLOAT::DOUBLE)::FLOAT AS b FROM range(64)),
    delays AS (SELECT ch, freq, (4150.0::DOUBLE / 0.0064::FLOAT::DOUBLE * (a * a - b * b)::DOUBLE)::FLOAT AS fd FROM inv),
    dms AS (SELECT range::INTEGER AS dm_idx, (range::FLOAT * 50::FLOAT)::FLOAT AS dm FROM range(20)),
    maxd AS (SELECT max(floor((dm * fd)::DOUBLE + 0.5::DOUBLE))::BIGINT AS maxd FROM dms, delays)"""


def shifts_sql(keep: str = "1") -> str:
    return f"shifts AS (SELECT dm_idx, dm, ch, round_even((dm * fd)::DOUBLE, 0)::BIGINT AS shift, ({keep})::INTEGER AS keep FROM dms, delays)"


def sums_sql(keep: str = "1", source: str = "fb") -> str:
    """CTEs up to ``ts`` (dm_idx, dm, t, sum)."""
    return f"""{FB}, {DELAYS}, {shifts_sql(keep)},
    pulse AS (SELECT fb.t, fb.ch, CASE WHEN fb.t = 50 + round_even((400::FLOAT * fd)::DOUBLE, 0)::BIGINT THEN least(v + 60, 255) ELSE v END::INTEGER AS v
              FROM fb JOIN delays USING (ch)),
    ts AS (SELECT dm_idx, dm, t - shift AS t, sum(v * keep)::BIGINT AS sum
           FROM {source} JOIN shifts USING (ch), n, maxd
           WHERE t - shift >= 0 AND t - shift < n - maxd GROUP BY ALL)"""


def scale_sql(top: str) -> str:
    x = f"(((sum::FLOAT * {top}::FLOAT)::DOUBLE / 16320::DOUBLE)::FLOAT * {numeric.SCALE!r}::FLOAT)"
    return x if top == "1" else f"trunc(least(greatest({x}, 0::FLOAT), {top}::FLOAT))::INTEGER"


def values_sql(rows, first: str, second: str) -> str:
    quoted = ", ".join("({}, '{}')".format(k, t.replace("'", "''")) for k, t in rows)
    return f"SELECT {first}::INTEGER AS {first}, {second} FROM (VALUES {quoted}) AS v({first}, {second})"


def unpack_sql(nbits: int) -> str:
    return f"""SELECT event_id AS id, k::INTEGER AS k, ((((event_id * 2654435761) % 4294967296)::BIGINT >> (k * {nbits})::INTEGER) & {(1 << nbits) - 1})::BIGINT AS v
               FROM events, range({32 // nbits}) r(k)"""


TS = f"WITH {sums_sql()} SELECT dm_idx, dm, t, sum FROM ts"
FOURIER = "SELECT dm_idx, {dm} t, round((sum - 127.5 * 64) / 64::DOUBLE, 7) + 0.0::DOUBLE AS value FROM ts {where}"
STATS = "count(*) AS n, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std"

SQL = {
    "delay_table": f"WITH {DELAYS} SELECT ch, freq::FLOAT AS freq, fd FROM delays",
    "dm_linear": f"WITH {DELAYS} SELECT dm_idx, dm FROM dms",
    "dm_explicit": "SELECT i::INTEGER AS dm_idx, d::FLOAT AS dm FROM (VALUES (0, 0.5), (1, 2.25), (2, 10.0), (3, 33.3)) AS v(i, d)",
    "dm_adaptive": """
        WITH RECURSIVE c AS (
            SELECT 0.00025::FLOAT::DOUBLE * 1e6::DOUBLE AS us, (1581.0::DOUBLE + 511.5::DOUBLE * (-0.09765625)::DOUBLE) * 1e-3::DOUBLE AS f
        ), k AS (SELECT pow(8.3::DOUBLE * (-0.09765625)::DOUBLE / (f * f * f), 2) AS a2, (us * us + 16::DOUBLE) * (1.25::DOUBLE * 1.25::DOUBLE - 1) AS c FROM c),
        trial(dm_idx, dm) AS (
            SELECT 0, 2::FLOAT
            UNION ALL
            SELECT dm_idx + 1,
                   ((a2 * 65536 * dm::DOUBLE + sqrt((a2 + a2 * 65536) * (c + 1.5625::DOUBLE * a2 * dm::DOUBLE * dm::DOUBLE) - a2 * a2 * 65536 * dm::DOUBLE * dm::DOUBLE))
                    / (a2 + a2 * 65536))::FLOAT
            FROM trial, k WHERE dm < 100::FLOAT
        ) SELECT dm_idx::INTEGER AS dm_idx, dm FROM trial""",
    "max_delay": f"WITH {DELAYS} SELECT maxd AS max_delay FROM maxd",
    "dm_delay": f"WITH {DELAYS} SELECT dm_idx, dm, floor((dm * fd)::DOUBLE + 0.5::DOUBLE)::BIGINT AS delay FROM dms, delays WHERE ch = 63",
    "smearing": """
        WITH k AS (SELECT 8.3::DOUBLE * 400 / pow(1381::DOUBLE, 3) AS k)
        SELECT range::INTEGER AS dm_idx, round(sqrt(0.0064::DOUBLE * 0.0064::DOUBLE + 0.004::DOUBLE * 0.004::DOUBLE + pow(k * range * 50, 2) + pow(k / 4 * 64 * 50, 2)), 6) AS smear
        FROM range(20), k""",
    "killmask": "SELECT range::INTEGER AS ch, (range % 5 <> 3)::INTEGER AS keep FROM range(64)",
    "shift_matrix": f"WITH {DELAYS}, {shifts_sql()} SELECT dm_idx, dm, ch, shift, keep FROM shifts",
    "spin_table": "SELECT range::INTEGER AS k, (range::DOUBLE / (2048 * 0.0064::FLOAT::DOUBLE))::FLOAT AS f FROM range(1025)",
    "chunk_table": """
        SELECT range::INTEGER AS chunk, range * 28705 AS isamp_start, least(range * 28705 + 32768, 100000) AS isamp_end,
               range * 16385 AS ifreq_start, (range + 1) * 16385 AS ifreq_end, 16385 AS nfreq_good
        FROM range(4)""",
    "chunk_spin_table": "SELECT c::INTEGER AS chunk, k::INTEGER AS k, (k::DOUBLE / (1024 * 0.0064::FLOAT::DOUBLE))::FLOAT AS f FROM range(5) a(c), range(513) b(k)",
    "fb_long": f"WITH {FB} SELECT t, ch, v FROM fb",
    "quantize_clamp": f"""
        WITH {FB} SELECT t, ch, least(greatest(floor((x * 400::FLOAT + 127.5::FLOAT)::DOUBLE + 0.5::DOUBLE), 0), 255)::INTEGER AS v FROM fb""",
    "quantize_affine": f"""
        WITH {FB}, r AS (SELECT min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM fb)
        SELECT t, ch, round(255.0::DOUBLE / (hi - lo) * x::DOUBLE + (-127.5::DOUBLE * (hi + lo) / (hi - lo)) + 127.5::DOUBLE, 0)::INTEGER AS v FROM fb, r""",
    "centre_scale": f"WITH {FB} SELECT t, ch, round((v - 127.5::DOUBLE) / 64::DOUBLE, 9) AS x FROM fb",
    "calibrate": f"WITH {FB} SELECT t, ch, ((floor((x * 100)::FLOAT)::FLOAT * (ch::FLOAT * 0.5::FLOAT) + 3::FLOAT) * 0.25::FLOAT)::FLOAT AS x FROM fb",
    **{f"unpack_{n}": unpack_sql(n) for n in (1, 2, 4, 8, 16, 32)},
    "expand_4_to_8": f"SELECT id, k, (v * 17)::BIGINT AS v FROM ({unpack_sql(4)})",
    "pack_round_trip": f"WITH {FB} SELECT t, sum(v >> 4)::BIGINT AS sum FROM fb GROUP BY t",
    "transpose_channel_major": f"WITH {FB} SELECT ch, string_agg(v::VARCHAR, ',' ORDER BY t) AS v FROM fb GROUP BY ch",
    "tdd_sum": TS,
    "tdd_f32": f"WITH {sums_sql()} SELECT dm_idx, dm, t, {scale_sql('1')} AS value FROM ts",
    "tdd_u8": f"WITH {sums_sql()} SELECT dm_idx, dm, t, {scale_sql('255')} AS value FROM ts",
    "tdd_u16": f"WITH {sums_sql()} SELECT dm_idx, dm, t, {scale_sql('65535')} AS value FROM ts",
    "tdd_killmask": f"WITH {sums_sql('ch % 5 <> 3')} SELECT dm_idx, dm, t, sum FROM ts",
    "tdd_all_killed": f"WITH {sums_sql('0')} SELECT dm_idx, dm, t, sum FROM ts",
    "tdd_dm_range": f"{TS} WHERE dm_idx BETWEEN 5 AND 8",
    "tdd_head_n": f"{TS} WHERE t < 50",
    "tdd_blocks": TS,
    "tdd_gulped": TS,
    "tdd_subbands": f"""
        WITH {sums_sql()} SELECT dm_idx, (ch // 8)::INTEGER AS band, t - shift AS t, sum(v)::BIGINT AS sum
        FROM fb JOIN shifts USING (ch), n, maxd WHERE t - shift >= 0 AND t - shift < n - maxd GROUP BY ALL""",
    "tdd_subbands_added": TS,
    "decimate_wide_2": f"""
        WITH {FB}, d AS (SELECT t // 2 AS t, ch, floor(sum(v) / 2)::BIGINT AS v FROM fb, n WHERE t < n // 2 * 2 GROUP BY t // 2, ch)
        SELECT t, sum(v)::BIGINT AS sum FROM d GROUP BY t""",
    "tdd_zero_dm": f"WITH {FB} SELECT t, sum(v)::BIGINT AS sum FROM fb GROUP BY t",
    "decimate_4": f"WITH {FB} SELECT t // 4 AS t, ch, floor(sum(v) / 4)::INTEGER AS v FROM fb, n WHERE t < n // 4 * 4 GROUP BY t // 4, ch",
    "channel_stats": f"WITH {FB} SELECT ch, {STATS} FROM fb GROUP BY ch",
    "global_stats": f"WITH {FB} SELECT {STATS} FROM fb",
    "inject_pulse": f"WITH {sums_sql()} SELECT t, ch, v FROM pulse",
    "detect_peaks": f"""
        WITH {sums_sql(source="pulse")}, s AS (SELECT avg(sum) AS m, stddev_samp(sum) AS d FROM ts)
        SELECT dm_idx, t, sum, round((sum - m) / d, 6) AS snr FROM ts, s WHERE sum - m > 3 * d ORDER BY dm_idx, t LIMIT 101""",
    "best_dm": f"""
        WITH {sums_sql(source="pulse")}, r AS (SELECT *, row_number() OVER (PARTITION BY dm_idx ORDER BY sum DESC, t) AS k FROM ts)
        SELECT dm_idx, t, sum AS peak FROM r WHERE k = 1""",
    "fdd_time": f"WITH {sums_sql()} {FOURIER.format(dm='dm,', where='')}",
    "fdd_segmented": f"WITH {sums_sql()} {FOURIER.format(dm='dm,', where='')}",
    "fdd_spectrum": f"WITH {sums_sql()} {FOURIER.format(dm='', where='')}",
    "telescope_names": values_sql([(i, names.telescope(i)) for i in range(17)], "id", "name"),
    "backend_names": values_sql([(i, names.backend(i)) for i in range(13)], "id", "name"),
    "error_strings": values_sql([*enumerate(MESSAGES), (17, "Invalid error code")], "code", "message"),
    "sexagesimal": """
        WITH x AS (SELECT range AS id, range * 1234.5::DOUBLE AS y FROM range(100)), a AS (SELECT id, y, floor(y / 10000) AS f FROM x),
        b AS (SELECT id, y, f, floor((y - f * 10000) / 100) AS m FROM a)
        SELECT id, f::INTEGER AS first, m::INTEGER AS minutes, y - f * 10000 - m * 100 AS seconds FROM b""",
    "inf_header": """
        SELECT range::INTEGER AS dm_idx, n::INTEGER AS line_no, replace(replace(x, '#name', printf('obs_DM%.3f', range * 50::DOUBLE)), '#dm', (range * 50)::VARCHAR) AS line
        FROM range(20), (VALUES
            (0, ' Data file name without suffix          =  #name'),
            (1, ' Telescope used                         =  Fake'),
            (2, ' Instrument used                        =  FAKE'),
            (3, ' Object being observed                  =  '),
            (4, ' J2000 Right Ascension (hh:mm:ss.ssss)  =  00:00:0.000000'),
            (5, ' J2000 Declination     (dd:mm:ss.ssss)  =  00:00:00.000000'),
            (6, ' Data observed by                       =  Unknown'),
            (7, ' Epoch of observation (MJD)             =  0.000000000000000'),
            (8, ' Barycentered?           (1=yes, 0=no)  =  0'),
            (9, ' Number of bins in the time series      =  100'),
            (10, ' Width of each time series bin (sec)    =  0.0064'),
            (11, ' Any breaks in the data? (1=yes, 0=no)  =  0'),
            (12, ' Type of observation (EM band)          =  Radio'),
            (13, ' Beam diameter (arcsec)                 =  3600'),
            (14, ' Dispersion measure (cm-3 pc)           =  #dm'),
            (15, ' Central freq of low channel (Mhz)      =  1187.25'),
            (16, ' Total bandwidth (Mhz)                  =  400'),
            (17, ' Number of channels                     =  64'),
            (18, ' Channel bandwidth (Mhz)                =  6.25'),
            (19, ' Data analyzed by                       =  Unknown'),
            (20, ' Any additional notes:'),
            (21, '    Input filterbank samples have 8 bits.')) AS v(n, x)""",
    "bench_log_stats": benchlog.EVENTS_SQL,
    "stream_tdd": TS,
    "stream_tdd_bands": TS,
}
