import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkchirp.functions import numeric
from sparkchirp.functions.codec import IN_NBITS, pack, pack_samples, subword, swap_endian, unpack, unpack_bytes
from sparkchirp.operators import detect, fourier, tables, timedomain
from sparkchirp.plans.search import SearchPlan
from sparkchirp.spec import Code, Flag, ObservationSpec, SearchError, linear_dms

SPEC = ObservationSpec(16, 6.4e-3, 1581.0, -25.0)
DMS = linear_dms(0.0, 60.0, 9)
N = 400


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(1).integers(0, 256, (N, 16))


@pytest.fixture(scope="module")
def wide(spark, data):
    return spark.createDataFrame([(t, [int(x) for x in row]) for t, row in enumerate(data)], "t long, v array<int>").repartition(3).cache()


def brute(data, spec, dms):
    shifts, good = spec.shifts(dms), len(data) - spec.max_delay(dms)
    return np.array([[sum(k * int(data[t + s, c]) for c, (s, k) in enumerate(zip(row, spec.killmask))) for t in range(good)] for row in shifts])


def grid(df, value="sum"):
    rows = df.select("dm_idx", "t", value).collect()
    out = np.full((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1), np.nan)
    for i, t, x in rows:
        assert np.isnan(out[i, t])
        out[i, t] = x
    return out


def test_both_forms_equal_brute_force(wide, data):
    want = brute(data, SPEC, DMS)
    assert np.array_equal(grid(timedomain.sums_relational(timedomain.to_long(wide), SPEC, DMS, N)), want)
    for gulp, block in ((1, 4), (97, 3), (10**6, 64), (65536, None)):
        assert np.array_equal(grid(timedomain.sums_blocks(wide, SPEC, DMS, N, gulp=gulp, dm_block=block)), want)
    arrays = timedomain.sums_blocks(wide, SPEC, DMS, N, gulp=150, arrays=True).orderBy("dm_idx", "gulp").collect()
    assert np.array_equal(np.concatenate([r.sums for r in arrays if r.dm_idx == 4]), want[4])


def test_missing_spectra_are_zeros_and_repeated_ones_add_up_in_every_form(spark, data):
    x = [(t, [int(v) for v in row]) for t, row in enumerate(data) if t not in (50, 51, 200)]
    odd = spark.createDataFrame([*x, x[10], x[300]], "t long, v array<int>").repartition(3)
    y = data.copy()
    y[[50, 51, 200]] = 0
    for t, row in (x[10], x[300]):
        y[t] += row
    want = brute(y, SPEC, DMS)
    got = grid(timedomain.sums_relational(timedomain.to_long(odd), SPEC, DMS, N))
    assert np.array_equal(np.nan_to_num(got), want) and np.argwhere(np.isnan(got)).tolist() == [[0, 50], [0, 51], [0, 200]]
    assert np.array_equal(grid(timedomain.sums_blocks(odd, SPEC, DMS, N, gulp=97, dm_block=4)), want)
    centred = (want - 127.5 * 16) / 16
    good = want.shape[1]
    assert np.allclose(grid(fourier.sums_fourier(odd, SPEC, DMS, N, segment=256), "value"), centred)
    back = fourier.series_from_spectra(fourier.spectra_fourier(odd, SPEC, DMS, N, 1024, trial_block=2), 1024, good)
    assert np.allclose(grid(back, "value"), centred)


def test_fourier_range_and_limits(spark, wide, data):
    plan = SearchPlan(spark, 16, 6.4e-3, 1581.0, -25.0, "fourier")
    plan.set_dm_list(DMS)
    got = plan.execute(wide, N, first_dm_idx=3, dm_count=2, segment=256)
    assert sorted(r.dm_idx for r in got.select("dm_idx").distinct().collect()) == [3, 4]
    assert np.allclose(grid(got, "value")[3:], (brute(data, SPEC, DMS)[3:5] - 127.5 * 16) / 16)
    assert plan.execute(wide, N, first_dm_idx=9).count() == 0
    with pytest.raises(SearchError):
        plan.execute(wide, N, out_nbits=8)
    with pytest.raises(ValueError, match="too long"):
        fourier.sums_fourier(wide, SPEC, DMS, 1 << 27, segment=None)


def test_auto_takes_either_form(spark, wide, data, monkeypatch):
    from sparkchirp.plans import search

    plan = SearchPlan(spark, 16, 6.4e-3, 1581.0, -25.0, "auto")
    plan.set_dm_list(DMS)
    seen = []
    for limit in (0, 1 << 40):
        monkeypatch.setattr(search, "RELATIONAL_CELLS", limit)
        out = plan.execute(wide, N)
        seen.append("FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString())
        assert out.count() == 9 * (N - plan.max_delay)
    assert seen == [True, False]


def test_measured_run(spark, wide):
    plan = SearchPlan(spark, 16, 6.4e-3, 1581.0, -25.0)
    plan.set_dm_list(DMS)
    series, figures = plan.measure(wide, N)
    assert series.count() == 9 * (N - plan.max_delay) and figures["seconds"] > 0 and figures["summing"] == (N - plan.max_delay) * 16 * 9 * 2.5


def test_channel_major_in_blocks(wide, data):
    rows = timedomain.channel_major(timedomain.to_long(wide), 150).collect()
    assert len(rows) == 16 * 3 and all(np.array_equal(r.v, data[r.block * 150 : (r.block + 1) * 150, r.ch]) for r in rows)


def test_close_trials_take_the_exchange_path():
    x = np.random.default_rng(2).integers(0, 9, (40, 90)).astype(np.int32)
    shifts = np.sort(np.random.default_rng(3).integers(0, 3, (12, 40)), axis=0)
    keep = np.arange(40) % 7 != 0
    want = [[sum(x[c, s[c] + t] for c in range(40) if keep[c]) for t in range(80)] for s in shifts]
    assert np.array_equal(timedomain.block_sums(x, shifts, keep, 80), want)


def test_killmask(wide, data):
    some = SPEC.with_killmask([c % 3 for c in range(16)])
    assert np.array_equal(grid(timedomain.sums_blocks(wide, some, DMS, N)), brute(data, some, DMS))
    none = SPEC.with_killmask([0] * 16)
    assert timedomain.sums_relational(timedomain.to_long(wide), none, DMS, N).agg(F.count("*"), F.max("sum")).first()[:] == (9 * (N - SPEC.max_delay(DMS)), 0)


def test_zero_trial_is_the_plain_sum(wide, data):
    assert np.array_equal(grid(timedomain.sums_blocks(wide, SPEC, [0.0], N))[0], data.sum(axis=1))


def test_trial_range_and_edges(spark, wide, data):
    part = timedomain.sums_blocks(wide, SPEC, DMS, N, first=2, count=3)
    assert {r[0] for r in part.select("dm_idx").distinct().collect()} == {2, 3, 4}
    assert np.array_equal(grid(part)[2:], brute(data, SPEC, DMS)[2:5])
    delay = SPEC.max_delay(DMS)
    assert timedomain.sums_blocks(wide.where(F.col("t") < delay), SPEC, DMS, delay).count() == 0
    assert timedomain.sums_relational(timedomain.to_long(wide), SPEC, DMS, delay).count() == 0
    with pytest.raises(SearchError) as e:
        timedomain.sums_blocks(wide, SPEC, DMS, delay - 1)
    assert e.value.code == Code.TOO_FEW_NSAMPS


@pytest.mark.parametrize("segment", [None, 64, 256, 16384])
def test_fourier_equals_time(wide, data, segment):
    got = grid(fourier.sums_fourier(wide, SPEC, DMS, N, segment=segment, dm_block=4), "value")
    assert np.abs(got - (brute(data, SPEC, DMS) - 127.5 * 16) / 16).max() < 1e-6


def test_fourier_modes_and_extrapolation(wide, data):
    same = grid(fourier.sums_fourier(wide, SPEC, DMS, N, segment=256, extrapolate=True), "value")
    assert np.abs(same - (brute(data, SPEC, DMS) - 127.5 * 16) / 16).max() < 1e-6
    near = grid(fourier.sums_fourier(wide, SPEC, DMS, N, delay_mode="frac"), "value")
    assert near.shape == same.shape and np.abs(near[0] - same[0]).max() < 1e-6
    exact = np.asarray(DMS, np.float32)[:, None] * SPEC.delays()[None, :]
    assert np.array_equal(fourier.sample_delays(SPEC, DMS, "trunc"), np.trunc(exact))
    masked = SPEC.with_killmask([1] * 8 + [0] * 8)
    got = grid(fourier.sums_fourier(wide, masked, DMS, N), "value")
    assert np.abs(got - (brute(data, masked, DMS) - 127.5 * 8) / 16).max() < 1e-6


def test_spectra_and_back(wide, data):
    nfft = 1024
    spectrum = fourier.spectra_fourier(wide, SPEC, DMS[:3], N, nfft, channel_block=5)
    good = N - SPEC.max_delay(DMS[:3])
    got = grid(fourier.series_from_spectra(spectrum, nfft, good), "value")
    assert np.abs(got - (brute(data, SPEC, DMS[:3]) - 127.5 * 16) / 16).max() < 1e-6


@pytest.mark.parametrize("nbits", IN_NBITS)
def test_pack_round_trip(spark, nbits):
    v = np.random.default_rng(nbits).integers(0, 1 << nbits, (7, 13))
    assert np.array_equal(unpack_bytes(pack_samples(v, nbits), nbits)[:, :13], v)
    df = spark.createDataFrame([(t, [int(x) for x in row]) for t, row in enumerate(v)], "t long, v array<long>")
    back = unpack(pack(df, nbits), nbits, 13).orderBy("t").collect()
    assert np.array_equal([r.v for r in back], v)


def test_packing_is_least_significant_first(spark):
    assert pack_samples(np.array([[1, 0, 1, 1, 0, 0, 0, 1]]), 1).tolist() == [[0b10001101]]
    assert pack_samples(np.array([[3, 12]]), 4).tolist() == [[0xC3]]
    row = spark.range(1).select(*[subword(F.lit(0xABCD1234), F.lit(k), 8).alias(f"k{k}") for k in range(4)]).first()
    assert list(row) == [0x34, 0x12, 0xCD, 0xAB]
    assert swap_endian(b"\x01\x02\x03\x04") == b"\x04\x03\x02\x01"
    with pytest.raises(SearchError):
        pack_samples(np.zeros((1, 1), int), 3)


def test_stride(spark):
    df = spark.createDataFrame([(0, bytearray([1, 2, 99, 99])), (1, bytearray([3, 4, 99, 99]))], "t long, raw binary")
    assert [r.v for r in unpack(df, 8, 2, stride=4).orderBy("t").collect()] == [[1, 2], [3, 4]]
    with pytest.raises(SearchError) as e:
        unpack(df, 8, 2, stride=1)
    assert e.value.code == Code.INVALID_STRIDE


def test_scaling(spark):
    df = spark.createDataFrame([(0,), (8158,), (10**6,)], "s long")
    row = lambda n: [r[0] for r in df.select(numeric.scale_output(F.col("s"), 8, n, 64)).collect()]
    assert row(32)[1] == pytest.approx(0.376378, abs=1e-6) and row(8) == [0, 95, 255] and row(16)[2] == 65535


def test_quantisers(spark):
    df = spark.createDataFrame([(-500.0,), (-127.5,), (0.0,), (0.49,), (500.0,)], "x double")
    assert [r[0] for r in df.select(numeric.quantise(F.col("x"))).collect()] == [0, 0, 128, 128, 255]
    slope, intercept = numeric.affine_range(df, "x")
    assert [r[0] for r in df.select(numeric.quantise_affine(F.col("x"), slope, intercept)).collect()][::4] == [0, 255]
    assert numeric.affine_range(df.limit(1), "x") == (0.0, 0.0)


def test_pulse_is_found(spark):
    spec, dms = ObservationSpec(32, 1e-3, 1500.0, -10.0), linear_dms(0.0, 20.0, 16)
    long = detect.noise(spark, spec, 1500, 10.0)
    series = timedomain.sums_relational(detect.inject_pulse(long, spec, 160.0, 300, 60), spec, dms, 1500)
    best = series.orderBy(F.desc("sum")).first()
    assert (best.dm_idx, best.t) == (8, 300)
    found = detect.peaks(series, 6.0, value="sum").collect()
    assert (8, 300) in {(r.dm_idx, r.t) for r in found} and len(found) <= 101
    assert [(r.dm_idx, r.t) for r in found] == sorted((r.dm_idx, r.t) for r in found)


def test_generators_and_decimation(spark, wide, data):
    got = detect.decimate(timedomain.to_long(wide), 7, N)
    want = data[: N // 7 * 7].reshape(-1, 7, 16).sum(axis=1) // 7
    assert {(r.t, r.ch): r.v for r in got.collect()} == {(t, c): want[t, c] for t in range(len(want)) for c in range(16)}
    wave = detect.sine(spark, ObservationSpec(4, 0.1, 1e6, -25000.0), 26).where("ch = 2").orderBy("t").collect()
    assert np.allclose([r.x for r in wave], np.sin(np.pi * np.arange(26) * float(np.float32(0.1))))
    assert detect.counting_wide(spark, 8, 3).count() == 3 and detect.counting(spark, 8, 3).count() == 24
    assert detect.throughput(10, 20, 4, 2, 1e-9)["summing"] == 200


def test_shapes(wide, data):
    rows = timedomain.channel_major(timedomain.to_long(wide)).collect()
    assert all(np.array_equal(r.v, data[:, r.ch]) for r in rows)
    again = timedomain.to_wide(timedomain.to_long(wide)).orderBy("t").collect()
    assert np.array_equal([r.v for r in again], data)


def test_plan(spark, wide, data):
    for method in ("relational", "time"):
        plan = SearchPlan(spark, 16, 6.4e-3, 1581.0, -25.0, method)
        plan.set_dm_list(DMS)
        plan.gulp_size = 128
        assert plan.gulp_size == 128 and plan.max_delay == SPEC.max_delay(DMS) and plan.dm_count == 9
        got = grid(plan.execute(wide, out_nbits=8, first_dm_idx=3, dm_count=2), "value")[3:]
        top = np.float32(255)
        want = np.trunc(np.clip(((brute(data, SPEC, DMS)[3:5].astype(np.float32) * top) / np.float32(255 * 16)).astype(np.float32) * np.float32(numeric.SCALE), 0, top))
        assert np.array_equal(got, want)
    plan = SearchPlan(spark, 16, 6.4e-3, 1581.0, -25.0, "fourier")
    plan.set_dm_list(DMS)
    assert plan.sync(plan.execute(wide)) == 9 * (N - plan.max_delay)
    with pytest.raises(SearchError):
        plan.gulp_size = 5


def test_validation_order(spark, wide):
    plan = SearchPlan(spark, 16, 6.4e-3, 1581.0, -25.0)

    def code(**kw):
        with pytest.raises(SearchError) as e:
            plan.execute(**({"wide": wide, "nsamps": N} | kw))
        return e.value.code

    both = Flag.HOST_POINTERS | Flag.DEVICE_POINTERS
    bad = {"in_nbits": 3, "out_nbits": 7, "flags": both, "in_stride": 0}
    assert code(wide=None) == Code.INVALID_POINTER
    assert code(**bad) == Code.INVALID_STRIDE
    del bad["in_stride"]
    assert code(**bad) == Code.NO_DM_LIST_SET
    plan.set_dm_list(DMS)
    assert code(nsamps=3, in_stride=0) == Code.TOO_FEW_NSAMPS
    assert code(**bad) == Code.INVALID_FLAG_COMBINATION
    del bad["flags"]
    assert code(**bad) == Code.UNSUPPORTED_IN_NBITS
    assert code(out_nbits=7) == Code.UNSUPPORTED_OUT_NBITS
    with pytest.raises(SearchError):
        plan.set_dm_list(None)
    with pytest.raises(SearchError):
        plan.set_dm_list([5.0, 1.0])


def test_segments(spark):
    assert tables.segment_plan(100000, 4063) == (32768, 28705, 4)
    with pytest.raises(SearchError):
        tables.segment_plan(10, 11)
    assert tables.segment_table(spark, 100000, 4063).count() == 4
