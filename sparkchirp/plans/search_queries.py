"""Named queries over the plan object, the frequency domain's modes and spectra, coarse trials and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.codec import swap_word
from ..operators import decimate, detect, fourier, timedomain
from ..spec import Code, Flag, ObservationSpec, SearchError, linear_dms
from .catalogue import DELAYS, DMS, FB, FOURIER, GULP, KILLED, SPEC, TS, _samples, _words, filterbank, scale_sql, shifts_sql, sums_sql
from .search import SearchPlan

#: The padded length of the whole series' transform, and an angle for each sample (up to it) and bin.
TURN = """
    z AS (SELECT ((n + maxd + 1023) // 1024 * 1024)::BIGINT AS nfft FROM n, maxd),
    turn AS (SELECT t, k::INTEGER AS k, 2 * pi() * ((t * k) % nfft) / nfft AS a FROM (SELECT nfft, unnest(range(nfft)) AS t FROM z), range((SELECT nfft // 2 + 1 FROM z)) r(k))"""


def _plan(spark, method: str = "time", mask=None) -> SearchPlan:
    plan = SearchPlan(spark, 64, 6.4e-3, 1581.0, -6.25, method)
    plan.set_dm_list(DMS)
    if mask is not None:
        plan.set_killmask(mask)
    return plan


def executed(method: str, out_nbits: int = 32, mask=None, **arguments):
    def query(spark, sf_dir):
        plan = _plan(spark, method, mask)
        if method != "fourier":
            plan.gulp_size = GULP
        out = plan.execute(filterbank(spark, sf_dir), out_nbits=out_nbits, **arguments)
        return out.withColumn("value", F.round("value", 7) + F.lit(0.0)) if method == "fourier" else out

    return query


def getters(spark, sf_dir):
    """What a plan tells about itself, before and after its gulp size is set."""
    plan = _plan(spark, mask=KILLED)
    before = plan.gulp_size
    plan.gulp_size = 1000
    row = (plan.channel_count, plan.dm_count, plan.max_delay, plan.dm_delay(19), plan.dt, plan.f0, plan.df, before, plan.gulp_size, sum(plan.killmask), len(plan.delay_table), plan.dm_list[-1])
    names = "channels long, trials long, max_delay long, last_delay long, dt double, f0 double, df double, gulp long, gulp_set long, alive long, delays long, last_dm double"
    return spark.createDataFrame([row], names)


def checks(spark, sf_dir):
    """(test, code): the first wrong argument decides, in a fixed order."""
    wide = filterbank(spark, sf_dir)
    n = _samples(wide)
    bare, late = SearchPlan(spark, 64, 6.4e-3, 1581.0, -6.25), _plan(spark, "fourier")

    def code(run) -> int:
        try:
            run()
        except SearchError as e:
            return int(e.code)
        return int(Code.NO_ERROR)

    both = Flag.HOST_POINTERS | Flag.DEVICE_POINTERS
    plan = _plan(spark)
    all_wrong = {"in_nbits": 3, "out_nbits": 7, "flags": both, "in_stride": 1}
    found = {
        "no data": lambda: plan.execute(None, 10),
        "too short": lambda: plan.execute(wide, plan.max_delay - 1, **all_wrong),
        "in stride": lambda: plan.execute(wide, n, **all_wrong),
        "out stride": lambda: plan.execute(wide, n, out_stride=1, in_nbits=3),
        "no trials": lambda: bare.execute(wide, n, in_nbits=3),
        "flags": lambda: plan.execute(wide, n, **all_wrong | {"in_stride": None}),
        "in depth": lambda: plan.execute(wide, n, in_nbits=3, out_nbits=7),
        "out depth": lambda: plan.execute(wide, n, out_nbits=7),
        "fourier depth": lambda: late.execute(wide, n, out_nbits=8),
        "fourier gulp": lambda: late.gulp_size,
        "method": lambda: SearchPlan(spark, 64, 6.4e-3, 1581.0, -6.25, "other"),
        "channels": lambda: SearchPlan(spark, 8193, 6.4e-3, 1581.0, -0.05),
        "most channels": lambda: SearchPlan(spark, 8192, 6.4e-3, 1581.0, -0.05),
        "list order": lambda: bare.set_dm_list([2.0, 1.0]),
        "no list": lambda: bare.set_dm_list(None),
    }
    return spark.createDataFrame([(k, code(run)) for k, run in found.items()], "test string, code int")


def synced(spark, sf_dir):
    wide = filterbank(spark, sf_dir)
    return spark.createDataFrame([(SearchPlan.sync(_plan(spark).execute(wide)),)], "n long")


def measured(spark, sf_dir):
    """A run with its figures: those that do not depend on the machine."""
    wide = filterbank(spark, sf_dir)
    series, figures = _plan(spark).measure(wide, _samples(wide))
    good = figures["seconds"] > 0 and abs(figures["gops"] * figures["seconds"] * 1e9 - figures["preprocessing"] - figures["summing"]) < 1
    return series.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(figures["preprocessing"]).alias("preprocessing"), F.lit(figures["summing"]).alias("summing"), F.lit(good).alias("adds_up"))


def fourier_mode(**options):
    def query(spark, sf_dir):
        wide = filterbank(spark, sf_dir)
        out = fourier.sums_fourier(wide, SPEC, DMS, _samples(wide), segment=256, **options)
        return out.withColumn("value", F.round("value", 7) + F.lit(0.0))

    return query


def fraction(spark, sf_dir):
    """Whole series with fractional delays."""
    wide = filterbank(spark, sf_dir)
    n = _samples(wide)
    nfft = numeric.round_up(n + SPEC.max_delay(DMS), 1024)
    spectrum = fourier.spectra_fourier(wide, SPEC, DMS, n, nfft, delay_mode="frac")
    good = timedomain.output_samples(n, SPEC.max_delay(DMS))
    return fourier.series_from_spectra(spectrum, nfft, good).withColumn("value", F.round("value", 6) + F.lit(0.0))


def spectrum_bins(spark, sf_dir):
    """The spectra themselves; a little is added before rounding, since some values lie halfway."""
    wide = filterbank(spark, sf_dir)
    n = _samples(wide)
    out = fourier.spectra_fourier(wide, SPEC, DMS, n, numeric.round_up(n + SPEC.max_delay(DMS), 1024))
    return out.select("dm_idx", "k", *[(F.round(F.col(c) + 3.3e-7, 5) + F.lit(0.0)).alias(c) for c in ("re", "im")])


def scrunched(spark, sf_dir):
    wide = filterbank(spark, sf_dir)
    sums = decimate.sums_scrunched(wide, SPEC, DMS, _samples(wide), [1] * 8 + [2] * 12)
    return sums.select("dm_idx", "t", "sum", "factor")


def factors(spark, sf_dir):
    dms = linear_dms(0.0, 100.0, 40)
    found = decimate.resolution_factors(ObservationSpec(64, 64e-6, 1581.0, -6.25), dms, 40.0, 1.25)
    return spark.createDataFrame(list(zip(range(40), dms, found, strict=True)), "dm_idx int, dm float, factor int")


def phasor_query(spark, sf_dir):
    k = F.col("event_id") % 513
    cos, sin = numeric.phasor(k.cast("double") / 1024, (F.col("event_id") % 37).cast("double"))
    c, s = numeric.complex_multiply((cos, sin), (F.lit(0.5), F.lit(-2.0)))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", *[(F.round(x, 8) + F.lit(0.0)).alias(n) for x, n in ((cos, "re"), (sin, "im"), (c, "product_re"), (s, "product_im"))])


def sizes(spark, sf_dir):
    rows = [(x, numeric.round_up(x, 96), numeric.div_round_up(x, 96), numeric.is_power_of_two(x), numeric.next_power_of_two(x)) for x in range(1, 1100)]
    return spark.createDataFrame(rows, "x int, up int, parts int, is_power boolean, next_power int")


def major_blocks(spark, sf_dir):
    """Channel-major rows of 128 samples."""
    blocks = timedomain.channel_major(timedomain.to_long(filterbank(spark, sf_dir)), 128)
    return blocks.select("ch", "block", F.concat_ws(",", F.col("v").cast("array<string>")).alias("v"))


def throughput_table(spark, sf_dir) -> DataFrame:
    rows = [(ndm, *(detect.throughput(4647940, 4689920, 1024, ndm, 2.0)[k] for k in ("preprocessing", "summing", "gops"))) for ndm in (128, 256, 512, 1024, 2048, 4096)]
    return spark.createDataFrame(rows, "trials int, preprocessing double, summing double, gops double")


QUERIES = {
    "plan_time_u8": executed("time", 8),
    "plan_time_u16": executed("time", 16),
    "plan_time_f32_masked": executed("time", 32, KILLED),
    "plan_relational_u8": executed("relational", 8),
    "plan_auto_f32": executed("auto", 32),
    "plan_time_range": executed("time", 32, None, first_dm_idx=5, dm_count=4),
    "plan_fourier_range": executed("fourier", 32, None, first_dm_idx=5, dm_count=4, segment=256),
    "plan_getters": getters,
    "plan_checks": checks,
    "plan_sync": synced,
    "plan_measure": measured,
    "fdd_trunc": fourier_mode(delay_mode="trunc"),
    "fdd_extrapolated": fourier_mode(extrapolate=True),
    "fdd_frac": fraction,
    "fdd_spectrum_bins": spectrum_bins,
    "tdd_scrunched": scrunched,
    "resolution_factors": factors,
    "phasors": phasor_query,
    "sizes": sizes,
    "endian_swap": lambda s, d: _words(s, d).select("id", swap_word(F.col("word")).alias("swapped")),
    "transpose_blocks": major_blocks,
    "throughput": throughput_table,
}

_CODES = [
    ("no data", Code.INVALID_POINTER), ("too short", Code.TOO_FEW_NSAMPS), ("in stride", Code.INVALID_STRIDE), ("out stride", Code.INVALID_STRIDE), ("no trials", Code.NO_DM_LIST_SET),
    ("flags", Code.INVALID_FLAG_COMBINATION), ("in depth", Code.UNSUPPORTED_IN_NBITS), ("out depth", Code.UNSUPPORTED_OUT_NBITS), ("fourier depth", Code.UNSUPPORTED_OUT_NBITS), ("fourier gulp", Code.INVALID_PLAN),
    ("method", Code.INVALID_PLAN), ("channels", Code.NCHANS_EXCEEDS_LIMIT), ("most channels", Code.NO_ERROR), ("list order", Code.INVALID_PLAN), ("no list", Code.INVALID_POINTER),
]


def plan_sql(top: str, keep: str = "1", where: str = "") -> str:
    return f"WITH {sums_sql(keep)} SELECT dm_idx, dm, t, {scale_sql(top)} AS value FROM ts {where}"


SQL = {
    "plan_time_u8": plan_sql("255"),
    "plan_time_u16": plan_sql("65535"),
    "plan_time_f32_masked": plan_sql("1", "ch % 5 <> 3"),
    "plan_relational_u8": plan_sql("255"),
    "plan_auto_f32": plan_sql("1"),
    "plan_time_range": plan_sql("1", where="WHERE dm_idx BETWEEN 5 AND 8"),
    "plan_fourier_range": f"WITH {sums_sql()} {FOURIER.format(dm='dm,', where='WHERE dm_idx BETWEEN 5 AND 8')}",
    "plan_getters": f"""
        WITH {DELAYS} SELECT 64::BIGINT AS channels, 20::BIGINT AS trials, maxd AS max_delay, maxd AS last_delay, 0.0064::FLOAT::DOUBLE AS dt, 1581.0::DOUBLE AS f0, -6.25::DOUBLE AS df,
               65536::BIGINT AS gulp, 1000::BIGINT AS gulp_set, (SELECT count(*) FROM range(64) r(ch) WHERE ch % 5 <> 3) AS alive, 64::BIGINT AS delays, 950::DOUBLE AS last_dm FROM maxd""",
    "plan_checks": "SELECT test, code::INTEGER AS code FROM (VALUES " + ", ".join(f"('{k}', {int(c)})" for k, c in _CODES) + ") AS v(test, code)",
    "plan_sync": f"SELECT count(*) AS n FROM ({TS})",
    "plan_measure": f"""
        WITH n AS (SELECT count(*) AS n FROM embeddings), {DELAYS}
        SELECT (n - maxd) * 20 AS n, 5.0::DOUBLE * n * 64 AS preprocessing, (n - maxd) * 64 * 20 * 2.5::DOUBLE AS summing, true AS adds_up FROM n, maxd""",
    "fdd_trunc": f"""
        WITH {FB}, {DELAYS}, {shifts_sql().replace("round_even((dm * fd)::DOUBLE, 0)", "trunc((dm * fd)::DOUBLE)")},
        ts AS (SELECT dm_idx, dm, t - shift AS t, sum(v)::BIGINT AS sum FROM fb JOIN shifts USING (ch), n, maxd WHERE t - shift >= 0 AND t - shift < n - maxd GROUP BY ALL)
        {FOURIER.format(dm='dm,', where='')}""",
    "fdd_extrapolated": f"WITH {sums_sql()} {FOURIER.format(dm='dm,', where='')}",
    "fdd_frac": f"""
        WITH {FB}, {DELAYS}, {TURN}, x AS (SELECT t, ch, (v - 127.5) / 64::DOUBLE AS x FROM fb),
        spec AS (SELECT ch, k, sum(x * cos(a)) AS re, -sum(x * sin(a)) AS im FROM x JOIN turn USING (t) GROUP BY ch, k),
        rot AS (SELECT dm_idx, k, sum(re * cos(p) - im * sin(p)) AS re, sum(re * sin(p) + im * cos(p)) AS im
                FROM (SELECT dm_idx, k, re, im, 2 * pi() * k * (dm * fd)::DOUBLE / nfft AS p FROM spec JOIN delays USING (ch), dms, z) GROUP BY dm_idx, k)
        SELECT dm_idx, t, round(sum(CASE WHEN k IN (0, nfft // 2) THEN re * cos(a) ELSE 2 * (re * cos(a) - im * sin(a)) END) / any_value(nfft), 6) + 0.0::DOUBLE AS value
        FROM rot JOIN turn USING (k), z, n, maxd WHERE t < n - maxd GROUP BY dm_idx, t""",
    "fdd_spectrum_bins": f"""
        WITH {FB}, {DELAYS}, {shifts_sql()}, {TURN},
        s AS (SELECT dm_idx, (t - shift + nfft) % nfft AS t, sum((v - 127.5) / 64::DOUBLE) AS x FROM fb JOIN shifts USING (ch), z GROUP BY ALL)
        SELECT dm_idx, k, round(sum(x * cos(a)) + 3.3e-7::DOUBLE, 5) + 0.0::DOUBLE AS re, round(3.3e-7::DOUBLE - sum(x * sin(a)), 5) + 0.0::DOUBLE AS im FROM s JOIN turn USING (t) GROUP BY dm_idx, k""",
    "tdd_scrunched": f"""
        WITH {FB}, {DELAYS}, fine AS (SELECT dm_idx, ch, round_even((dm * fd)::DOUBLE, 0)::BIGINT AS shift FROM dms, delays WHERE dm_idx < 8),
        slow AS (SELECT ch, (4150.0::DOUBLE / 0.0128::FLOAT::DOUBLE * (a * a - b * b)::DOUBLE)::FLOAT AS fd FROM inv),
        coarse AS (SELECT dm_idx, ch, dm, fd, round_even((dm * fd)::DOUBLE, 0)::BIGINT AS shift FROM dms, slow WHERE dm_idx >= 8),
        m AS (SELECT (SELECT max(floor((dm * fd)::DOUBLE + 0.5))::BIGINT FROM dms, delays WHERE dm_idx < 8) AS m1, (SELECT max(floor((dm * fd)::DOUBLE + 0.5))::BIGINT FROM coarse) AS m2),
        half AS (SELECT t // 2 AS t, ch, floor(sum(v) / 2)::BIGINT AS v FROM fb, n WHERE t < n // 2 * 2 GROUP BY t // 2, ch)
        SELECT dm_idx, t - shift AS t, sum(v)::BIGINT AS sum, 1 AS factor FROM fb JOIN fine USING (ch), n, m WHERE t - shift >= 0 AND t - shift < n - m1 GROUP BY ALL
        UNION ALL
        SELECT dm_idx, t - shift AS t, sum(v)::BIGINT AS sum, 2 AS factor FROM half JOIN coarse USING (ch), n, m WHERE t - shift >= 0 AND t - shift < n // 2 - m2 GROUP BY ALL""",
    "resolution_factors": """
        WITH s AS (SELECT range::INTEGER AS dm_idx, (range * 100)::FLOAT AS dm, pow(8.3e3::DOUBLE * 6.25 * range * 100 / pow(1381::DOUBLE, 3) * 1e6, 2) + 1600 AS rest, pow(64e-6::FLOAT::DOUBLE * 1e6, 2) AS d2 FROM range(40))
        SELECT dm_idx, dm, pow(2, (SELECT max(e) FROM range(30) r(e) WHERE e = 0 OR sqrt(pow(4, e) * d2 + rest) <= 1.25 * sqrt(d2 + rest)))::INTEGER AS factor FROM s""",
    "phasors": """
        WITH a AS (SELECT event_id, 2 * pi() * ((event_id % 513)::DOUBLE / 1024) * (event_id % 37) AS a FROM events), p AS (SELECT event_id, cos(a) AS c, sin(a) AS s FROM a)
        SELECT event_id, round(c, 8) + 0.0::DOUBLE AS re, round(s, 8) + 0.0::DOUBLE AS im, round(c * 0.5 + s * 2, 8) + 0.0::DOUBLE AS product_re, round(-2 * c + s * 0.5, 8) + 0.0::DOUBLE AS product_im FROM p""",
    "sizes": """
        SELECT x::INTEGER AS x, ((x + 95) // 96 * 96)::INTEGER AS up, ((x + 95) // 96)::INTEGER AS parts, bit_count(x) = 1 AS is_power,
               (SELECT min(1 << e) FROM range(12) r(e) WHERE (1 << e) >= x)::INTEGER AS next_power FROM range(1, 1100) q(x)""",
    "endian_swap": """
        WITH w AS (SELECT event_id AS id, ((event_id * 2654435761) % 4294967296)::BIGINT AS w FROM events)
        SELECT id, ((w & 255) << 24) | (((w >> 8) & 255) << 16) | (((w >> 16) & 255) << 8) | (w >> 24) AS swapped FROM w""",
    "transpose_blocks": f"WITH {FB} SELECT ch, t // 128 AS block, string_agg(v::VARCHAR, ',' ORDER BY t) AS v FROM fb GROUP BY ch, t // 128",
    "throughput": """
        SELECT trials::INTEGER AS trials, 5.0::DOUBLE * 4689920 * 1024 AS preprocessing, 4647940::DOUBLE * 1024 * trials * 2.5::DOUBLE AS summing,
               (5.0::DOUBLE * 4689920 * 1024 + 4647940::DOUBLE * 1024 * trials * 2.5::DOUBLE) / 2 / 1e9 AS gops FROM (VALUES (128), (256), (512), (1024), (2048), (4096)) AS v(trials)""",
}
