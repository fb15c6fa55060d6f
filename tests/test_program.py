import numpy as np

from sparkchirp.operators import decimate, timedomain
from sparkchirp.plans import program
from sparkchirp.sources.filterbank import Header, header_bytes
from sparkchirp.spec import ObservationSpec, linear_dms

SPEC = ObservationSpec(8, 6.4e-3, 1581.0, -25.0)


def test_search_of_a_file(spark, tmp_path):
    data = np.random.default_rng(4).integers(0, 256, (300, 8)).astype(np.uint8)
    (tmp_path / "a.fil").write_bytes(header_bytes(Header(tsamp=6.4e-3, fch1=1581.0, foff=-25.0, nchans=8)) + data.tobytes())
    for method in ("time", "relational", "fourier"):
        done = program.search_file(spark, str(tmp_path / "a.fil"), str(tmp_path / method / "p"), 0.0, step=40.0, trials=4, method=method).orderBy("dm_idx").collect()
        dms = linear_dms(0.0, 40.0, 4)
        n = (300 - SPEC.max_delay(dms)) // 2 * 2
        assert [r.samples for r in done] == [n] * 4
        series = np.fromfile(done[2].path, "<f4")
        sums = np.array([sum(int(data[t + s, c]) for c, s in enumerate(SPEC.shifts(dms)[2])) for t in range(n)])
        want = (sums - 127.5 * 8) / 8 if method == "fourier" else sums / (255 * 8) * 0.7529412
        assert np.allclose(series, want, atol=1e-3)
    program.main(["-f", str(tmp_path / "a.fil"), "-o", str(tmp_path / "cli" / "q"), "-r", "0,20", "-d", "3", "-N", "11", "-t", "2.0"])
    files = sorted(p.name for p in (tmp_path / "cli").glob("*.dat"))
    assert files and files[0] == "q_DM0.000.dat" and (tmp_path / "cli" / files[0]).stat().st_size == 40


def test_timing_program(spark):
    rows = program.time_search(spark, nchans=16, nsamps=5000, trials=4, iterations=2)
    assert len(rows) == 2 and rows[0]["computed"] + rows[0]["max_delay"] == 5000


def test_coarse_trials(spark):
    data = np.random.default_rng(5).integers(0, 256, (300, 8))
    wide = spark.createDataFrame([(t, [int(x) for x in r]) for t, r in enumerate(data)], "t long, v array<int>")
    dms = linear_dms(0.0, 50.0, 3)
    got = decimate.sums_scrunched(wide, SPEC, dms, 300, [1, 2, 2]).collect()
    coarse = data[:300].reshape(150, 2, 8).sum(axis=1) // 2
    spec2 = ObservationSpec(8, float(np.float32(6.4e-3)) * 2, 1581.0, -25.0)
    for r in got:
        if r.dm_idx == 2:
            assert r.sum == sum(int(coarse[r.t + s, c]) for c, s in enumerate(spec2.shifts([100.0])[0]))
    assert {(r.dm_idx, r.factor) for r in got} == {(0, 1), (1, 2), (2, 2)}
    factors = decimate.resolution_factors(ObservationSpec(1024, 64e-6, 1581.0, -0.39), [0.0, 500.0, 5000.0], 4.0, 1.25)
    assert factors == sorted(factors) and factors[0] == 1 and factors[-1] > 1
    assert timedomain.to_long(decimate.decimate_wide(wide, 7, 300)).count() == 42 * 8
