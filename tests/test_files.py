import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkchirp.sources import benchlog, outputs, subints
from sparkchirp.sources.filterbank import Header, header_bytes, parse_header, read_filterbank, read_header, read_raw, write_filterbank, write_raw
from sparkchirp.spec import SearchError

HEAD = Header(
    tsamp=6.4e-3, tstart=55000.25, fch1=1581.0, foff=-6.25, nchans=8, nbits=8, src_raj=123456.7, src_dej=-54321.5, telescope_id=4, machine_id=10, source_name="J0000-0000"
)


def test_header_round_trip_and_unknown_fields():
    data = header_bytes(HEAD)
    assert parse_header(data) == (HEAD, len(data))
    odd = data.replace(b"\x0a\x00\x00\x00HEADER_END", (3).to_bytes(4, "little") + b"xyz" + (5000).to_bytes(4, "little") + b"\x0a\x00\x00\x00HEADER_END")
    assert parse_header(odd)[0] == HEAD
    with pytest.raises(SearchError):
        parse_header(data[:-3])


@pytest.mark.parametrize("nbits", [1, 2, 4, 8, 16, 32])
def test_file_round_trip(spark, tmp_path, nbits):
    v = np.random.default_rng(nbits).integers(0, 1 << nbits, (50, 8))
    wide = spark.createDataFrame([(t, [int(x) for x in row]) for t, row in enumerate(v)], "t long, v array<long>").repartition(3)
    parts = write_filterbank(wide, Header(**HEAD.__dict__ | {"nbits": nbits}), str(tmp_path / "out"), samples=20).orderBy("part").collect()
    assert [r.samples for r in parts] == [20, 20, 10]
    back = [x for r in parts for x in read_filterbank(spark, r.path, samples=7).orderBy("t").collect()]
    assert np.array_equal([r.v for r in back], v)
    head, _, samples = read_header(parts[1].path)
    assert samples == 20 and head.tstart == pytest.approx(55000.25 + 20 * 6.4e-3 / 86400)


def test_raw_with_padding(spark, tmp_path):
    path = tmp_path / "input.bin"
    path.write_bytes(b"\xff" * 3 + bytes([1, 2, 9, 9, 3, 4, 9, 9, 5, 6]))
    rows = read_raw(spark, str(path), 2, skip=3, stride=4).orderBy("t").collect()
    assert [r.v for r in rows] == [[1, 2], [3, 4], [5, 6]]


def test_series_files(spark, tmp_path):
    series = spark.range(0, 22).select((F.col("id") % 2).cast("int").alias("dm_idx"), (F.col("id") % 2 * 12.5).cast("float").alias("dm"), F.expr("id div 2").alias("t"), (F.col("id") * 0.5).alias("value"))
    done = outputs.write_series(series, HEAD, str(tmp_path), "obs", 9).orderBy("dm_idx").collect()
    assert [r.samples for r in done] == [8, 8] and done[1].path.endswith("obs_DM12.500.dat")
    assert np.fromfile(done[1].path, "<f4").tolist() == [0.5 + k for k in range(8)]
    text = (tmp_path / "obs_DM12.500.inf").read_text()
    for line in (
        " Telescope used                         =  Parkes",
        " Instrument used                        =  ARTEMIS",
        " J2000 Right Ascension (hh:mm:ss.ssss)  =  12:34:56.700000",
        " J2000 Declination     (dd:mm:ss.ssss)  = -05:43:21.500000",
        " Epoch of observation (MJD)             =  55000.250000000000000",
        " Width of each time series bin (sec)    =  0.0064",
        " Dispersion measure (cm-3 pc)           =  12.5",
        " Central freq of low channel (Mhz)      =  1537.25",
        " Number of bins in the time series      =  8",
        "    Input filterbank samples have 8 bits.",
    ):
        assert line in text.split("\n")
    outputs.write_table(series, str(tmp_path / "t"), "dm_idx")
    outputs.write_timings(spark, [(1.0, 2.0, 3.0, 6.0)], str(tmp_path / "perf"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 22


def test_raw_files_and_recordings_round_trip(spark, tmp_path):
    v = np.random.default_rng(5).integers(0, 16, (50, 8))
    wide = spark.createDataFrame([(t, [int(x) for x in row]) for t, row in enumerate(v)], "t long, v array<long>").repartition(3)
    parts = write_raw(wide, 4, str(tmp_path / "raw"), stride=7, samples=20).orderBy("part").collect()
    back = [r.v for p in parts for r in read_raw(spark, p.path, 8, 4, stride=7).orderBy("t").collect()]
    assert np.array_equal(back, v)
    layout = subints.Layout(nchans=3, pols=1, spectra=4, rows=5, header=10, gap=5)
    rows = [(i, [1.0, 2.0, 3.0], [float(i)] * 3, [0.5] * 3, bytes(range(12))) for i in range(5)]
    table = spark.createDataFrame(rows, "subint int, wts array<float>, offs array<float>, scl array<float>, data binary").repartition(3)
    assert subints.write_subints(table, str(tmp_path / "r" / "rec.bin"), layout).first().rows == 5
    got = subints.read_subints(spark, str(tmp_path / "r" / "rec.bin"), layout).orderBy("subint").collect()
    assert [(r.subint, r.wts, r.offs, r.scl, bytes(r.data)) for r in got] == rows


def test_subints(spark, tmp_path):
    layout = subints.Layout(nchans=3, pols=2, spectra=4, rows=2, header=10, gap=5)
    rng = np.random.default_rng(0)
    blob, want = b"\0" * 10, []
    for _ in range(2):
        w, o, s = rng.random(3, np.float32), rng.random(6, np.float32), rng.random(6, np.float32)
        raw = rng.integers(0, 256, (4, 2, 3)).astype(np.uint8)
        blob += b"\0" * 5 + w.astype(">f4").tobytes() + o.astype(">f4").tobytes() + s.astype(">f4").tobytes() + raw.tobytes()
        want += [((raw[t, 1].astype(np.float32) * s[3:] + o[3:]) * w) for t in range(4)]
    path = tmp_path / "rec.bin"
    path.write_bytes(blob)
    got = subints.calibrated(subints.read_subints(spark, str(path), layout), layout, pol=1).orderBy("t").collect()
    assert np.allclose([r.v for r in got], want, rtol=1e-6)


def test_bench_log(spark, tmp_path):
    (tmp_path / "GPU_tdd_nchan1024_ndm128.txt").write_text("Runtime             : 1.50 sec.\nnoise\nRuntime             : 2.50 sec.\nTotal time          : 3.0 and 4.0\n")
    times = benchlog.timings(benchlog.read_logs(spark, str(tmp_path)))
    rows = {r.timing: r for r in benchlog.summary(times).collect()}
    assert (rows["Runtime"].n, rows["Runtime"].mean, rows["Runtime"].std) == (2, 2.0, 0.5) and rows["Total time"].mean is None
    table = benchlog.mean_table(times)
    row = table.first()
    assert row.sort_by == "GPU:tdd:1024:128" and row["Runtime"] == 2.0 and table.columns == ["test", "sort_by", *benchlog.LABELS]
    other = spark.createDataFrame([("t", "Some other time : 1.0 sec.")], "test string, line string")
    assert benchlog.timings(other).count() == 0
    benchlog.write_mean_table(times, str(tmp_path / "summary"))
