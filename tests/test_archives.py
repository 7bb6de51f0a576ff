"""Archives, headers, media forms, the data source and the command line, on values and on broken files."""

import json
import struct

import numpy as np
import pytest

from procframe import cli
from procframe.functions import media, registry
from procframe.sources import archive, datasource

LAYOUT = archive.LAYOUT


def test_header_round_trip():
    header = archive.Header(original_size=7, compressed_size=9, original_hash=bytes(range(32)), flags=3, payload_type="LZMA_FALLBACK", engine="fallback_lzma", file_type="AUDIO")
    data = archive.pack_header(header)
    assert len(data) == 66 and archive.unpack_header(data) == header
    assert archive.unpack_header(archive.pack_header(archive.Header(version=(1, 0)))).version == (1, 1)


def test_first_version_has_no_payload_type():
    data = archive.V1.pack(LAYOUT.magic, 1, 0, 1, 0, 11, 12, bytes(32), 0)
    found = archive.unpack_header(data + b"rest")
    assert (found.size, found.payload_type, found.original_size, found.compressed_size) == (65, "PROCEDURAL", 11, 12)


def test_unknown_payload_types_count_as_procedural():
    data = bytearray(archive.pack_header(archive.Header()))
    data[13] = 0x77
    assert archive.unpack_header(bytes(data)).payload_type == "PROCEDURAL"


@pytest.mark.parametrize("at, value", [(0, 0), (11, 99), (12, 9)])
def test_broken_headers(at, value):
    data = bytearray(archive.pack_header(archive.Header()))
    data[at] = value
    with pytest.raises(ValueError):
        archive.unpack_header(bytes(data))
    with pytest.raises(ValueError):
        archive.unpack_header(bytes(data[:40]))


@pytest.mark.parametrize("values", [
    np.sin(2 * np.pi * 5 * np.arange(100) / 100), np.linspace(0, 1, 200) ** 2 * 2 - 1, np.random.default_rng(1).normal(size=(7, 3)), np.arange(40, dtype=np.int32), np.zeros(0), np.frombuffer(b"text " * 9, np.uint8), np.full(100, 3.14),
])
def test_round_trip(values):
    data = archive.compress(values)
    back = archive.decompress(data).values
    assert back.shape == values.shape
    procedural = archive.unpack_header(data).payload_type == "PROCEDURAL"
    assert np.mean((back - values) ** 2) <= 0.0101 * max(values.var(), 1e-9) if procedural else (back == values).all() and back.dtype == values.dtype


def test_sizes_of_smooth_and_random_data():
    sine = np.sin(2 * np.pi * 5 * np.arange(100_000) / 100_000).astype(np.float32)
    assert len(sine.tobytes()) / len(archive.compress(sine)) > 1000
    noise = np.random.default_rng(2).random(1000).astype(np.float32)
    assert archive.unpack_header(archive.compress(noise)).payload_type == "LZMA_FALLBACK"


def test_verify_holds_the_hash():
    data = bytearray(archive.compress(np.random.default_rng(3).normal(size=50)))
    assert archive.decompress(bytes(data), verify=True).values.size == 50
    data[31] ^= 1
    with pytest.raises(ValueError, match="hash"):
        archive.decompress(bytes(data), verify=True)


def test_other_magic():
    other = archive.with_magic(b"OTHERMAGI", "OTHER_")
    data = archive.compress(b"abc", other)
    assert archive.decompress(data, other).values.tobytes() == b"abc"
    with pytest.raises(ValueError):
        archive.decompress(data)


def form(kind, **params):
    return json.dumps({"magic": getattr(LAYOUT, kind), "version": [1, 0], "params": params}).encode()


def test_media_forms():
    solid = archive.decompress(form("image", pattern="solid_color", width=64, height=64, channels=3, color=[255, 128, 0]))
    assert solid.kind == "image" and (solid.values == [255, 128, 0]).all() and solid.values.shape == (64, 64, 3)
    sound = archive.decompress(b"  " + form("audio", pattern="sine_wave", sample_rate=22050, duration=0.05, channels=1, frequencies=[[440, 1, 0]]))
    assert sound.rate == 22050 and len(sound.values) == 1102 and np.abs(sound.values).max() > 1000
    grey = archive.decompress(form("texture", texture_type="wood", width=4, height=2))
    assert grey.values.shape == (2, 4, 3) and (grey.values == 128).all()
    video = archive.decompress(json.dumps({"magic": LAYOUT.video, "pattern": "static"}).encode())
    assert video.values is None and video.parameters["pattern"] == "static"


@pytest.mark.parametrize("data", [b"", b"short", b"neither this nor that", b'{"magic": "NOBODY"}', b"{broken json....", LAYOUT.magic + bytes(20), archive.compress(b"abc")[:70], archive.pack_header(archive.Header(payload_type="LZMA_FALLBACK")) + b"\xff\xff\xff\xff", archive.pack_header(archive.Header()) + b'{"type":"generator"}', archive.pack_header(archive.Header()) + b'{"type":"other"}'])
def test_broken_files(data):
    with pytest.raises(ValueError):
        archive.decompress(data)


@pytest.mark.parametrize("shape", [[], [0], [-1], [20_000_000], "no", [True]])
def test_shapes_are_checked(shape):
    with pytest.raises(ValueError):
        registry.generate("polynomial", 0, {"coefficients": [1]}, shape)


def test_generators_by_name():
    assert registry.generate("GeneratorType.POLYNOMIAL", 0, {"coefficients": [2, 1]}, [100])[[0, -1]].tolist() == [1, 3]
    assert registry.generate("fourier", 0, {"is_simple_sine": True, "frequency": 10}, [500]).max() == pytest.approx(1, abs=3e-3)
    assert registry.generate("perlin_noise", 5, {"scale": 4}, [9]).shape == (9,)
    with pytest.raises(ValueError):
        registry.generate("spline", 0, {}, [4])

    @registry.register("ramp")
    def ramp(seed, parameters, shape):
        return np.arange(np.prod(shape)) + seed

    assert registry.generate("ramp", 2, {}, [2, 2]).tolist() == [[2, 3], [4, 5]]
    del registry.TYPES["ramp"]


def test_legacy_payloads():
    import lzma

    body = {"type": "lzma", "data": lzma.compress(np.arange(6, dtype="<f4").tobytes()).hex(), "metadata": {"shape": [2, 3], "dtype": "float32"}}
    data = archive.pack_header(archive.Header()) + json.dumps(body).encode()
    assert archive.decompress(data).values.tolist() == [[0, 1, 2], [3, 4, 5]]


@pytest.mark.parametrize("data, options, mode", [(np.arange(100, dtype="<f4").tobytes(), {}, "quantized8"), (b"odd", {}, "lossless"), (bytes(400), {"lossless": True}, "lossless"), (bytes(range(8)), {"raw": True}, "raw")])
def test_short_archives(data, options, mode):
    packed = archive.compress_short(data, **options)
    header = archive.short_header(packed)
    assert (header["mode"], header["original_size"], header["shape"][0]) == (mode, len(data), len(data) // 4)
    back = archive.decompress_short(packed)
    assert back == data if mode != "quantized8" else np.abs(np.frombuffer(back, "<f4") - np.frombuffer(data, "<f4")).max() <= 99 / 255
    with pytest.raises(ValueError):
        archive.decompress_short(b"PFZ\x01")
    with pytest.raises(ValueError):
        archive.decompress_short(struct.pack("<4s4B4IQ", LAYOUT.short, 1, 2, 0, 1, 0, 0, 0, 0, 0))


def test_loading_values(tmp_path):
    np.save(tmp_path / "a.npy", np.arange(3.0))
    assert archive.load_values((tmp_path / "a.npy").read_bytes()).tolist() == [0, 1, 2]
    assert archive.load_values(b" 1.5 2\n-3e2 ").tolist() == [1.5, 2, -300]
    assert archive.load_values(b"\x00\x01ab").tolist() == [0, 1, 97, 98]
    assert archive.load_values(np.arange(2, dtype="<f4").tobytes() + b"x", "b.f32").tolist() == [0, 1]


def test_scan_reads_headers_alone(spark):
    first = archive.V1.pack(LAYOUT.magic, 1, 0, 2, 3, 2**40, 12, bytes([200] * 32), 2**31)
    rows = [("a", bytearray(archive.compress(b"abc"))), ("b", bytearray(first)), ("c", bytearray(b"{}" + b" " * 20)), ("d", bytearray(archive.compress_short(b"abc"))), ("e", bytearray(b"x")), ("f", None)]
    frame = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in archive.scan(frame).collect()}
    assert (got["a"].format, got["a"].original_size, got["a"].payload_type, got["a"].header_size) == ("archive", 3, "LZMA_FALLBACK", 66)
    assert (got["b"].file_type, got["b"].engine, int(got["b"].original_size), got["b"].flags, got["b"].original_hash, got["b"].header_size) == ("IMAGE", "fallback_lzma", 2**40, 2**31, "c8" * 32, 65)
    assert [got[k].format for k in "cde"] == ["json", "short", "small"] and got["c"].version is None and got["f"].version is None
    assert "Python" not in archive.scan(frame)._jdf.queryExecution().executedPlan().toString()


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    rows = [(f"s{i}", [float(i)] * 5 + [0.5 * i]) for i in range(6)] + [("empty", [])]
    spark.createDataFrame(rows, "path string, values array<double>").repartition(3).write.format("procframe").option("path", str(tmp_path / "out")).mode("overwrite").save()
    back = {r.path.rsplit("/", 1)[1]: (r.n, r["values"], r.error) for r in spark.read.format("procframe").load(str(tmp_path / "out")).collect()}
    assert back == {name: (len(v), v, None) for name, v in rows}
    (tmp_path / "out" / "broken").write_bytes(b"neither this nor that")
    files = archive.files(spark, str(tmp_path / "out"))
    assert [r.error for r in archive.read(files).collect() if r.path.endswith("broken")] == ["unknown format"]


def test_command_line(tmp_path, capsys):
    source = tmp_path / "in.dat"
    source.write_bytes(np.random.default_rng(1).bytes(550) + b"odd")
    for options in ([], ["--short"]):
        assert cli.main(["compress", str(source), "-o", str(tmp_path / "x.pfz"), *options]) == 0
        assert cli.main(["info", str(tmp_path / "x.pfz")]) == 0
        assert cli.main(["decompress", str(tmp_path / "x.pfz"), "-o", str(tmp_path / "back")]) == 0
        assert (tmp_path / "back").read_bytes() == source.read_bytes()
    assert cli.main(["benchmark", str(source)]) == 0 and "mb_per_s" in capsys.readouterr().out
    assert cli.main(["info", str(source)]) == 1 and cli.main(["compress", str(tmp_path / "absent")]) == 1


def test_waves():
    clip = {"pattern": "sine_wave", "sample_rate": 1000, "duration": 0.2, "channels": 2, "frequencies": [[100, 1, 0]]}
    import io
    import wave

    with wave.open(io.BytesIO(media.wav(clip, 33))) as file:
        assert (file.getnchannels(), file.getframerate(), file.getnframes()) == (2, 1000, 200)
        assert (np.frombuffer(file.readframes(200), "<i2").reshape(-1, 2) == media.audio(clip)).all()
    data = media.wav_float(np.array([0.5, -1]), 8000)
    assert len(data) == 52 and data[:4] == b"RIFF" and struct.unpack_from("<HHI", data, 20) == (3, 1, 8000) and np.frombuffer(data[44:], "<f4").tolist() == [0.5, -1]
    assert (np.concatenate(list(media.audio_chunks({**clip, "pattern": "noise_white", "noise_amplitude": 0.2}, 7))) == media.audio({**clip, "pattern": "noise_white", "noise_amplitude": 0.2})).all()


def test_video_frames():
    params = {"pattern": "slide", "width": 6, "height": 4, "fps": 4, "duration": 1, "motion_vectors": [{"mean_dx": 1.0, "mean_dy": 0.0}], "keyframes": [[0, {"pattern": "solid_color", "width": 6, "height": 4, "color": [7, 7, 7]}]]}
    frames = list(media.video_frames(params))
    assert len(frames) == 4 and (frames[2][:, :2] == 0).all() and (frames[2][:, 2:] == 7).all()
    assert media.coloured(np.array([0, 0.25, 1]), [(0, 0), (100, 200)]).tolist() == [[0, 0], [25, 50], [100, 200]]
