"""Fits, codecs, DataFrame plans and streams, by the series that each model is meant for and by edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from procframe.functions import codecs, fits, media
from procframe.functions import sql as names
from procframe.operators import generators
from procframe.operators.byte_ops import entropy, least_size, log2_series, top_pair
from procframe.plans import compression
from procframe.streaming import series as streams

A512 = np.arange(512) / 512
U = lambda n: np.linspace(0, 1, n)


def test_each_model_fits_its_series():
    sine = fits.fit_sine(1.5 + 2 * np.sin(2 * np.pi * 8 * A512 + 0.3))
    assert sine.error < 0.01 and sine.coefficients[0] == 8 and abs(sine.coefficients[1] - 2) < 0.5
    chord = fits.fit_fourier(1.5 * np.sin(2 * np.pi * 3 * A512) + 0.8 * np.sin(2 * np.pi * 7 * A512))
    assert chord.error < 1e-9 and {chord.coefficients[0], chord.coefficients[3]} == {3, 7}
    quad = fits.fit_polynomial(2 * U(200) ** 2 - U(200) + 0.5)
    assert quad.error < 0.01 and fits.fit_polynomial(2 * U(200) ** 2 - U(200) + 0.5, variant="best").coefficients[-3:] == pytest.approx([2, -1, 0.5], abs=1e-6)


@pytest.mark.parametrize("values", [np.zeros(0), np.ones(1), np.full(4, 3.14), np.array([1.0, np.nan, 2, 3] * 4), np.array([1.0, np.inf, 2, 3] * 4), np.array([1e-10, 1e10, -1e10, 0, 1e-5])])
def test_edge_series(values):
    fit = fits.analyse(values)
    assert len(fits.reconstruct(fit, len(values))) == len(values)
    assert fits.fit_sine(values) is None or np.isfinite(fits.fit_sine(values).error)
    packed = compression.compress_values(values)
    back = compression.decompress_values(packed[0], len(values), *packed[1:5])
    assert np.allclose(back, values, rtol=1e-12, atol=1e-9, equal_nan=True)


def test_constants_have_degree_zero():
    assert fits.fit_polynomial(np.full(9, 2.5)) == fits.Fit("polynomial", [2.5], 0.0, 40)
    assert fits.fit_polynomial(np.ones(1)) is None and fits.fit_sine(np.arange(3.0)) is None and fits.fit_fourier(np.arange(7.0)) is None


def test_the_cheapest_model_wins_and_pays():
    assert fits.analyse(np.sin(2 * np.pi * 5 * A512)).method == "fourier"  # one term costs 60, a sine 64
    assert fits.analyse(np.sin(2 * np.pi * 5 * A512), "crossings").method == "fourier"
    assert fits.analyse(U(300) ** 2).method == "polynomial" and fits.analyse(U(12)).method == "lzma"  # 48 bytes don't pay 1.5 times
    state, noise = 1, []
    for _ in range(512):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        noise.append(state / 2**63 - 1)
    assert fits.analyse(np.array(noise)).method == "lzma"


def test_zero_crossings_fall_back_to_the_spectrum():
    slow = np.cos(2 * np.pi * 0.4 * A512)
    assert fits._crossings(slow - slow.mean()) is None and fits.fit_sine(slow, "crossings") is None
    assert fits.fit_sine(np.sin(2 * np.pi * 6.5 * A512), "crossings").coefficients[0] == pytest.approx(6.5, abs=0.1)


def test_pivoted_solver():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 5)), rng.normal(size=5)
    assert fits.solve(a, b) == pytest.approx(np.linalg.solve(a, b))
    assert fits.solve(np.array([[0, 1], [1, 0]]), np.array([2, 3])).tolist() == [3, 2]
    assert fits.solve(np.ones((2, 2)), np.ones(2)) is None and fits.solve(np.array([[np.nan, 1], [1, 2]]), np.ones(2)) is None


def test_fourier_series_overwrites():
    n = 20
    whole = fits.fourier_series(n, [(3, 5, 0.2), (17, 4, 1.0), (40, 9, 0), (3, 6, 0.4)], 0.5)
    assert whole == pytest.approx(0.5 + 2 * 6 / n * np.cos(2 * np.pi * 3 * np.arange(n) / n + 0.4))
    assert (fits.fourier_series(100, [], 5) == 5).all() and (fits.polynomial(100, []) == 0).all()


def test_frames_equal_values(spark):
    pairs = [
        (generators.sine_wave(spark, 50, 3, 2, 0.1, 1), fits.sine(50, 3, 2, 0.1, 1)), (generators.polynomial(spark, 50, [1, 2, 3]), fits.polynomial(50, [1, 2, 3])), (generators.polynomial(spark, 1, [5, 4]), np.array([4.0])),
        (generators.fourier(spark, 21, [(2, 3, 0.3), (10, 1, 0), (19, 7, 1), (-1, 2, 2)], 0.25), fits.fourier_series(21, [(2, 3, 0.3), (10, 1, 0), (19, 7, 1), (-1, 2, 2)], 0.25)), (generators.multi_sine(spark, 9, [], 2), np.full(9, 2.0)),
    ]
    for frame, values in pairs:
        assert np.array([r.value for r in frame.orderBy("i").collect()]) == pytest.approx(values, abs=1e-9)
    got = np.array([r.value for r in generators.perlin(spark, 30, 20, 7, 6.5, 3, 0.6, 2.5).orderBy("y", "x").collect()]).reshape(20, 30)
    assert got == pytest.approx(media.perlin(30, 20, 7, 6.5, 3, 0.6, 2.5), abs=1e-9) and 0 <= got.min() and got.max() <= 1
    for params in (
        {"pattern": "gradient_linear", "width": 30, "height": 20, "gradient_angle": 45.0}, {"pattern": "gradient_radial", "width": 30, "height": 20, "channels": 4, "gradient_end": (9, 8)},
        {"pattern": "checkerboard", "width": 9, "height": 7, "pattern_scale": 0.5}, {"pattern": "unknown", "width": 16, "height": 8, "dct_coefficients_b64": media.encode_coefficients([[0, 0, 900], [2, 3, 100]])}, {"pattern": "stripes", "width": 2, "height": 2},
    ):
        want = media.image(params)
        got = np.array([r.value for r in generators.image(spark, params).orderBy("y", "x", "ch").collect()]).reshape(want.shape)
        assert (np.abs(got - want) <= 1).all() and (got == want).mean() > 0.99


def test_same_seed_same_noise():
    assert (media.perlin(32, 32, 12345, 5, 3) == media.perlin(32, 32, 12345, 5, 3)).all() and (media.perlin(32, 32, 1, 5, 3) != media.perlin(32, 32, 2, 5, 3)).any()
    assert media.perlin(100, 50).shape == (50, 100)
    with pytest.raises(ValueError):
        media.perlin(0, 5)


def test_audio_equals_chunks(spark):
    clip = {"pattern": "multi_sine", "sample_rate": 1000, "duration": 0.3, "channels": 2, "frequencies": [[100, 0.7, 0], [33, 0.6, 0.2]], "global_max_amplitude": 1.1}
    frame = generators.audio(spark, clip, 70).orderBy("i", "ch").collect()
    assert np.array([r.value for r in frame]).reshape(-1, 2) == pytest.approx(media.audio(clip), abs=1) and {r.chunk for r in frame} == set(range(5))


def test_residual_containers():
    values = np.random.default_rng(3).normal(size=300)
    for method in [*codecs.METHODS, "zstd"]:
        r = codecs.compress_residual(values, method)
        again = codecs.Residual.from_bytes(r.to_bytes())
        assert again == r
        atol = np.ptp(values) / 255 if method == "quantized" else 1e-4
        assert codecs.decompress_residual(again) == pytest.approx(values, abs=atol)
    old = b'{"method":"zlib","shape":[2,3],"dtype":"float32"}'
    found = codecs.Residual.from_bytes(len(old).to_bytes(2, "little") + old + b"xy")
    assert (found.method, found.n, found.payload) == ("zlib", 6, b"xy")
    for broken in (b"abc", b"\xff\xff\xff\xff", (2).to_bytes(4, "little") + b"{}", (30).to_bytes(4, "little") + b'{"method":"no","version":2}   '):
        with pytest.raises(ValueError):
            codecs.Residual.from_bytes(broken)
    assert codecs.choose_residual(np.zeros(0)).method == "none" and codecs.choose_residual(values, lossy=False).method != "quantized"


@pytest.mark.parametrize("unpack, data", [(codecs.unpack_quantised, bytes(20)), (codecs.unpack_lossless, bytes(4)), (codecs.unpack_lossless, bytes(9)), (codecs.lzma_decompress, b"plain text"), (codecs.zlib_decompress, b"plain text"), (codecs.zstd_decompress, b"plain text"), (lambda d: codecs.unpack_levels(d, 8), bytes(8))])
def test_broken_codes(unpack, data):
    with pytest.raises(ValueError):
        unpack(data)


@pytest.mark.parametrize("bits", [8, 16, 12])
@pytest.mark.parametrize("rounding", ["half_away", "half_even", "truncate"])
def test_quantisers(bits, rounding):
    x = np.random.default_rng(4).normal(size=100) * 50
    levels, low, scale = codecs.quantise(x, bits, rounding)
    assert np.abs(codecs.dequantise(levels, bits, low, scale) - x).max() <= scale / (2**bits - 1) * (1 if rounding == "truncate" else 0.5) + 1e-9
    assert codecs.quantise(np.full(5, 7.0), bits)[1:] == (7.0, 1.0)
    assert codecs.unpack_levels(codecs.pack_levels(x, bits), bits) == pytest.approx(x, abs=scale / (2**bits - 1))


def test_subbands():
    assert [codecs.subband_settings(b) for b in ("LLL", "LHL", "HLH", "HHH")] == [(16, 6), (16, 5), (8, 3), (8, 1)]
    c = np.arange(-300, 300)
    assert (codecs.decompress_subband(codecs.compress_subband(c, "LLL")) == c).all()


@pytest.mark.parametrize("data, window, lookahead", [(b"abcabcabcabc", 256, 32), (b"a" * 100, 4096, 255), (b"x", 9, 9), (b"hello" * 100, 4096, 255), (b"abab", 0, 5), (b"abab", 5, 0), (b"", 5, 5), (bytes(range(256)) * 3, 300, 40)])
def test_lz77(data, window, lookahead):
    tokens = codecs.lz77_encode(data, window, lookahead)
    assert codecs.lz77_decode(tokens, len(data)) == data and codecs.lz77_decode(tokens)[: len(data)] == data
    # each token against a search of the whole window
    at = 0
    for offset, length, _ in tokens:
        best = max((n for start in range(max(0, at - window), at) for n in range(min(lookahead, len(data) - at, at - start), 0, -1) if data[start : start + n] == data[at : at + n]), default=0)
        assert length == best and (not length or offset == at - data.find(data[at : at + length], max(0, at - window)))
        at += length + 1


def test_phrase_list():
    held = codecs.PhraseList(3)
    assert [held.add(x) for x in (b"a", b"b", b"c", b"b", b"d")] == [0, 1, 2, 1, 2]
    assert (len(held), held.lookup(0), held.lookup(2), held.lookup(3), held.add(b"b")) == (3, b"b", b"d", None, 0)
    with pytest.raises(ValueError):
        codecs.PhraseList(0)


def test_bytes():
    assert entropy(bytes(range(256))) == 8 and entropy(bytes([42]) * 1000) == 0 and entropy(b"") == 0
    assert entropy(bytes(range(256)), 20) == pytest.approx(6.7369, abs=1e-3) and log2_series(np.array([1.0]), 20)[0] == 0
    assert least_size(bytes([0, 1]) * 500) == 125 and top_pair(b"aa") is None and top_pair(b"aaa") == (97, 97, 2)
    assert codecs.replace_pair(b"ababab", (97, 98), 88) == b"XXX" and codecs.replace_pair(b"abXab", (97, 98), 88) == b"XXX"


def test_residual_plans(spark):
    long = spark.createDataFrame([(s, p, float(v)) for s, vs in ((1, [1, 2, 4, 8]), (2, [5, 5, 5, 5])) for p, v in enumerate(vs)], "series_id long, pos long, value double")
    made = long.withColumn("value", F.lit(3.0))
    r = compression.residual(long, made)
    assert [x.value for x in r.where("series_id = 1").orderBy("pos").collect()] == [-2, -1, 1, 5]
    back = compression.add_residual(made, r, 0, 6).where("series_id = 1").orderBy("pos").collect()
    assert [x.value for x in back] == [1, 2, 4, 6]
    stats = {x.series_id: x for x in compression.residual_statistics(long, r).collect()}
    assert stats[1].mse == 31 / 4 and stats[1].relative_rmse == pytest.approx(np.sqrt(31 / 4) / 7) and stats[2].psnr == float("inf") and stats[2].method == "lzma"
    with pytest.raises(Exception, match="differ in shape"):
        compression.residual(long, made.where("pos > 0")).collect()
    packed = compression.pack_series(long)
    assert sorted(map(tuple, compression.unpack_series(packed).collect())) == sorted(map(tuple, long.collect()))


def test_designer(spark):
    n = 400
    rows = [(0, np.sin(2 * np.pi * 5 * np.arange(n) / n).tolist()), (1, (np.linspace(0, 1, n) ** 3 + np.random.default_rng(5).normal(size=n) * 0.01).tolist()), (2, np.random.default_rng(6).normal(size=n).tolist()), (3, []), (4, None)]
    packed = spark.createDataFrame(rows, "series_id long, values array<double>")
    for lossless, bits in ((True, None), (True, 8), (True, 16), (False, None)):
        compressed = compression.compress_series(packed, lossless, bits)
        got = {r.series_id: r["values"] for r in compression.decompress_series(compressed).collect()}
        assert sorted(got) == [0, 1, 2, 3, 4] and got[3] == [] and got[4] == []
        limit = 0.2 if not lossless else 1e-9 if bits is None else 0.05
        assert all(np.abs(np.array(got[i]) - rows[i][1]).max() <= limit for i in (0, 1, 2))
    totals = {r.series_id: r for r in compression.with_totals(compression.compress_series(packed)).collect()}
    assert totals[2].total_size == len(totals[2].residual) and totals[2].has_residual and totals[0].effective_ratio == pytest.approx(4 * n / totals[0].total_size) and totals[3].total_size > 0
    methods = {r.series_id: (r.method, r.residual is not None, r.lossless) for r in compression.compress_series(packed).collect()}
    assert methods[0][0] == "fourier" and methods[1][:2] == ("polynomial", True) and methods[2] == ("lzma", True, True)


def test_names_in_sql(spark):
    names.register(spark)
    assert spark.sql("SELECT count(*) FROM pf_sine(100, 2D, 1D, 0D, 0D)").first()[0] == 100
    assert spark.sql("SELECT max(value) FROM pf_polynomial(10, array(2D, 1D))").first()[0] == 3
    assert spark.sql("SELECT count(*) FROM pf_perlin(8, 4, 42, 10D, 2)").first()[0] == 32
    assert spark.sql("SELECT pf_entropy(cast('abab' AS binary))").first()[0] == 1
    fit = spark.sql("SELECT pf_fit_polynomial(cast(id AS double) * 2 + 1) FROM range(0, 50, 1, 1)").first()[0]
    assert '"method": "polynomial"' in fit and spark.sql("SELECT pf_residual_size(array(1D, 2D), 'none')").first()[0] == 8
    with pytest.raises(Exception, match="n must be"):
        spark.sql("SELECT * FROM pf_sine(0, 2D, 1D, 0D, 0D)").collect()


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()


def test_streams(spark, tmp_path):
    for part, rows in enumerate(([(1, 0, 1.0), (1, 1, 3.0), (2, 0, 5.0)], [(1, 2, 2.0), (2, 1, 5.5)])):
        spark.createDataFrame(rows, "series_id long, pos long, value double").coalesce(1).write.parquet(f"{tmp_path}/d{part}")
    source = spark.readStream.schema("series_id long, pos long, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/d*")
    run(streams.deltas(source), "deltas", "append")
    assert sorted(map(tuple, spark.table("deltas").collect())) == [(1, 0, 1.0), (1, 1, 2.0), (1, 2, -1.0), (2, 0, 5.0), (2, 1, 0.5)]
    for part, words in enumerate(("a b c", "b d")):
        spark.createDataFrame([("k", w) for w in words.split()], "key string, phrase string").coalesce(1).write.parquet(f"{tmp_path}/p{part}")
    source = spark.readStream.schema("key string, phrase string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p*")
    run(streams.phrase_lists(source, 3), "phrases")
    assert [(r.phrase, r["index"], r["size"]) for r in spark.table("phrases").collect()] == [("a", 0, 1), ("b", 1, 2), ("c", 2, 3), ("b", 1, 3), ("d", 2, 3)]


def test_windows_close_by_the_watermark(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}", float(2 * s)) for s in range(20)] + [(1, "2024-01-01 00:05:00", 1.0)]
    for part, chunk in enumerate((rows[:20], rows[20:], [(1, "2024-01-01 00:06:00", 1.0)], [(1, "2024-01-01 00:00:05", 99.0)])):
        spark.createDataFrame(chunk, "series_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/e{part}")
    source = spark.readStream.schema("series_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e*")
    run(streams.windowed_fit(source, "10 seconds", "30 seconds"), "fits")
    got = sorted(((r.n, r.slope, r.intercept) for r in spark.table("fits").where("n > 1").collect()), key=lambda g: g[2])
    assert [g[0] for g in got] == [10, 10] and got[0][1:] == pytest.approx((20, 0)) and got[1][1:] == pytest.approx((20, 20))
