"""Queries of the generators, the archives and the media forms, each with its definition as SQL for another engine."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media
from ..sources import archive
from . import generators as g
from .signals import table

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the queries; the SQL below states the same values in its own way.
COMPONENTS = [(3, 1.5, 0.0), (7, 0.8, 0.0)]
TERMS = [(3, 384.0, 0.2), (7, 204.8, 1.0), (256, 51.2, 0.0), (600, 9.0, 0.0), (3, 128.0, 0.4)]
COSINES = [(0, 0, 4096.0), (1, 2, 900.0), (5, 3, -700.0), (40, 2, 9.0), (63, 63, 200.0), (-1, 0, 5.0)]
SLIDE = {"pattern": "slide", "width": 24, "height": 16, "fps": 10, "duration": 1.2, "motion_vectors": [{"mean_dx": 0.5, "mean_dy": -0.25}],
         "keyframes": [[0.3, {"pattern": "checkerboard", "width": 24, "height": 16, "pattern_scale": 4}], [0.65, {"pattern": "solid_color", "width": 24, "height": 16, "color": [9, 8, 7]}]]}
CLIP = {"pattern": "sine_wave", "sample_rate": 8000, "duration": 0.1, "channels": 2, "frequencies": [(440.0, 1.0, 0.0)], "envelope": (0.0125, 0.025, 0.5, 0.025)}


def _values(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.withColumn("value", F.round("value", digits))


def _image(**params) -> Query:
    return lambda spark, sf_dir: g.image(spark, params).select("y", "x", "ch", "value")


def normal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = g.raster(spark, 32, 32).withColumn("value", (F.col("y") * F.col("y") + F.col("x") * 3.0) / 1024)
    found = g.normal_map(heights, 1.5)
    return found.select("y", "x", *[F.round(c, 6).alias(c) for c in "rgb"])


def perlin_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise as bytes and in the colours of a palette."""
    noise = g.perlin(spark, 48, 32, seed=42, scale=10.0, octaves=3)
    colour = g.coloured(F.round("value", 9), [(0, 0, 128), (255, 255, 0), (255, 0, 0)])
    return noise.select("y", "x", g.to_byte(F.round("value", 9)).alias("byte"), colour[0].alias("red"), colour[1].alias("green"))


def audio_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of white noise under its envelope, by chunk, to two digits' worth: they are the same for any partitions."""
    clip = g.audio(spark, {"pattern": "noise_white", "sample_rate": 8000, "duration": 2.0, "noise_amplitude": 0.1, "seed": 7, "envelope": (0.0, 0.0, 1.0, 0.0)}, 4000)
    return clip.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("value")) < 300).alias("centred"), F.stddev("value").between(3000, 3550).alias("spread"))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): an archive of each text, whose path is the document's id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    packed = F.pandas_udf(lambda texts: texts.map(archive.compress), "binary", functionType=F.PandasUDFType.SCALAR)
    return docs.select("path", packed("text").alias("content"))


def _headed(text: str) -> bytes:
    """A header as of an archive that holds the text as it is."""
    data = text.encode()
    return archive.pack_header(archive.Header(engine=archive.ENGINES[3], payload_type="LZMA_FALLBACK", original_size=len(data), compressed_size=len(data), original_hash=hashlib.sha256(data).digest())) + data


def header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of files with all texts say, read by expressions."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    headed = F.pandas_udf(lambda texts: texts.map(_headed), "binary", functionType=F.PandasUDFType.SCALAR)
    found = archive.scan(docs.select("path", headed("text").alias("content")))
    return found.select(F.col("path").cast("long").alias("doc_id"), "format", "version", "header_size", "file_type", "engine", "payload_type", F.col("original_size").cast("long").alias("original_size"), "original_hash", "flags", (F.col("compressed_size") + 66 == F.col("file_size")).alias("whole"))


def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts out of archives again, by their number and sum of bytes."""
    back = archive.read(_archives(spark, sf_dir), verify=True)
    total = F.aggregate("values", F.lit(0.0), lambda a, b: a + b).cast("long")
    return back.select(F.col("path").cast("long").alias("doc_id"), "kind", "n", total.alias("total"), "dtype", "error")


def archive_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of JSON forms and broken files."""
    layout = archive.LAYOUT
    forms = {
        "a": json.dumps({"magic": layout.image, "version": [1, 0], "params": {"pattern": "solid_color", "width": 4, "height": 3}}), "b": json.dumps({"magic": layout.audio, "version": [1, 2], "params": {"pattern": "silence", "sample_rate": 100, "duration": 0.5, "channels": 2}}),
        "c": json.dumps({"magic": layout.video, "version": [1, 0], "pattern": "static", "width": 2, "height": 2, "fps": 10, "duration": 1}), "d": " " + json.dumps({"magic": layout.texture, "params": {"texture_type": "solid", "width": 8, "height": 8}}), "e": json.dumps({"other": 1234567}), "f": "short", "g": "neither this nor that",
    }
    rows = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in forms.items()], "path string, content binary")

    def describe(content):
        out = []
        for x in content:
            try:
                i = archive.info(bytes(x))
                out.append((i["file_type"], i["original_size"], None))
            except ValueError as error:
                out.append((None, None, type(error).__name__))
        return out

    info = F.udf(lambda x: describe([x])[0], "file_type string, original_size long, error string")
    return rows.select("path", archive.sniffed(F.col("content")).alias("format"), info("content").alias("i")).select("path", "format", "i.file_type", F.coalesce("i.original_size", F.lit(-1)).alias("original_size"), "i.error")


def media_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and clips out of JSON forms, one for each of the first users' ids: sizes and sums."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    c = F.struct(F.lit("solid_color").alias("pattern"), F.lit(5).alias("width"), F.lit(4).alias("height"), F.lit(3).alias("channels"), F.array((F.col("user_id") % 256).cast("int"), F.lit(2), F.lit(3)).alias("color"))
    form = F.to_json(F.struct(F.lit(archive.LAYOUT.image).alias("magic"), c.alias("params")))
    found = archive.read(users.select(F.col("user_id").cast("string").alias("path"), F.encode(form, "UTF-8").alias("content")))
    return found.select(F.col("path").cast("long").alias("user_id"), "kind", "n", F.col("shape")[2].alias("channels"), F.aggregate("values", F.lit(0.0), lambda a, b: a + b).alias("total"))


def coefficients_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through base 64 of little-endian doubles and back."""
    def back(v):
        return v.map(lambda x: media.decode_coefficients(media.encode_coefficients([x[k : k + 3] for k in range(0, len(x) // 3 * 3, 3)])).ravel().tolist())

    decode = F.pandas_udf(back, "array<double>", functionType=F.PandasUDFType.SCALAR)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", decode(F.col("embedding").cast("array<double>")).alias("v"))
    return rows.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


QUERIES: dict[str, Query] = {
    "sine_wave": lambda spark, _: _values(g.sine_wave(spark, 512, 8, 2, 0.3, 1.5)),
    "multi_sine": lambda spark, _: _values(g.multi_sine(spark, 512, COMPONENTS, 0.25)),
    "fourier_generate": lambda spark, _: _values(g.fourier(spark, 512, TERMS, 0.5)),
    "polynomial_generate": lambda spark, _: _values(g.polynomial(spark, 200, [2, -1, 0.5])),
    "perlin_noise": lambda spark, _: _values(g.perlin(spark, 40, 25, seed=42, scale=10.0, octaves=4)),
    "perlin_advanced": lambda spark, _: _values(g.perlin(spark, 33, 20, seed=7, scale=6.5, octaves=3, persistence=0.7, lacunarity=3.0)),
    "perlin_image": perlin_image,
    "image_solid": _image(pattern="solid_color", width=64, height=64, color=(255, 128, 0)),
    "image_checkerboard": _image(pattern="checkerboard", width=64, height=64, pattern_scale=8, channels=1),
    "image_linear_gradient": _image(pattern="gradient_linear", width=100, height=50, channels=2, gradient_end=(255, 100)),
    "image_vertical_gradient": _image(pattern="gradient_linear", width=20, height=60, channels=1, gradient_angle=90, gradient_start=(200,), gradient_end=(10,)),
    "image_angled_gradient": _image(pattern="gradient_linear", width=64, height=48, channels=1, gradient_angle=30.0),
    "image_radial_gradient": _image(pattern="gradient_radial", width=100, height=80, channels=1, gradient_center=(0.25, 0.5)),
    "image_cosine": _image(pattern="periodic", width=64, height=32, channels=2, dct_coefficients=COSINES),
    "image_unknown": _image(pattern="fractal", width=5, height=4),
    "normal_map": normal_map,
    "audio_adsr_sine": lambda spark, _: g.audio(spark, CLIP, 300),
    "audio_normalised": lambda spark, _: g.audio(spark, {**CLIP, "pattern": "multi_sine", "channels": 1, "frequencies": [(261.63, 0.5, 0.0), (329.63, 0.5, 0.0)], "global_max_amplitude": 1.25}).select("i", "value"),
    "audio_silence": lambda spark, _: g.audio(spark, {"pattern": "silence", "sample_rate": 1000, "duration": 0.05}).select("i", "value"),
    "audio_noise": audio_noise,
    "video_keyframes": lambda spark, _: g.video_frames(spark, SLIDE).select("frame", "keyframe", "dx", "dy"),
    "video_pixels": lambda spark, _: g.video(spark, SLIDE).where("ch = 0").select("frame", "y", "x", "value"),
    "header_scan": header_scan,
    "archive_roundtrip": archive_roundtrip,
    "archive_info": archive_info,
    "media_read": media_read,
    "coefficients_base64": coefficients_base64,
}


def _r(n: int) -> str:
    return f"(SELECT range AS i FROM range({n}))"


def _perlin(width: int, height: int, seed: int, scale: float, octaves: int, persistence: float, lacunarity: float) -> str:
    """Noise as sums over the four corners of a cell, by a table of corners and gradients."""
    table = media.permutation(seed).tolist()
    angle = "CASE c WHEN 0 THEN 0 WHEN 1 THEN 180 WHEN 2 THEN 90 WHEN 3 THEN 270 WHEN 4 THEN 45 WHEN 5 THEN 135 WHEN 6 THEN 315 ELSE 225 END"
    weight = lambda t, d: f"CASE {d} WHEN 0 THEN 1 - {t} ELSE {t} END"
    return f"""
        SELECT y, x, round(greatest(0, least(1, 0.5 + sum(w * n) / {sum(persistence**k for k in range(octaves))!r} / 2)), 6) AS value FROM (
            SELECT y, x, o, w, sum(({weight('u', 'dx')}) * ({weight('v', 'dy')}) * (cos(radians({angle})) * (fx - dx) + sin(radians({angle})) * (fy - dy))) AS n FROM (
                SELECT *, p[((p[((ix + dx) % 256 + 1)::INT] + (iy + dy) % 256) % 256 + 1)::INT] % 8 AS c, fx ** 3 * (10 - 15 * fx + 6 * fx * fx) AS u, fy ** 3 * (10 - 15 * fy + 6 * fy * fy) AS v FROM (
                    SELECT *, floor(px)::BIGINT AS ix, floor(py)::BIGINT AS iy, px - floor(px) AS fx, py - floor(py) AS fy FROM (
                        SELECT a.i AS y, b.i AS x, o.i AS o, {persistence!r}::DOUBLE ** o.i AS w, b.i / {scale!r}::DOUBLE * {lacunarity!r}::DOUBLE ** o.i AS px, a.i / {scale!r}::DOUBLE * {lacunarity!r}::DOUBLE ** o.i AS py, {table} AS p
                        FROM {_r(height)} a, {_r(width)} b, {_r(octaves)} o)), (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy))
            GROUP BY y, x, o, w) GROUP BY y, x"""


_NOISE = _perlin(48, 32, 42, 10.0, 3, 0.5, 2.0).replace(", 6) AS value", ", 9) AS value")
_ENVELOPE = "CASE WHEN i < 100 THEN i / 100 WHEN i < 300 THEN 1.25 - i / 400 WHEN i < 600 THEN 0.5 ELSE 0.5 - (i - 600) / 400 END"
_PIXELS = f"SELECT a.i AS y, b.i AS x FROM {_r(32)} a, {_r(64)} b"
ORACLES: dict[str, str] = {
    "sine_wave": f"SELECT i, round(3 * 0.5 + 2 * cos(pi() * (i / 32 - 0.5) + 0.3), 6) AS value FROM {_r(512)}",
    "multi_sine": f"SELECT i, round(sum(a * sin(2 * pi() * ((f * i) % 512) / 512)) + 0.25, 6) AS value FROM {_r(512)}, (VALUES (3, 1.5), (7, 0.8)) c(f, a) GROUP BY i",
    "fourier_generate": f"SELECT i, round(0.5 + 0.5 * cos(2 * pi() * 3 * i / 512 + 0.4) + 0.8 * cos(2 * pi() * 7 * i / 512 + 1) + CASE WHEN i % 2 = 0 THEN 0.1 ELSE -0.1 END, 6) AS value FROM {_r(512)}",
    "polynomial_generate": f"SELECT i, round(2 * (i / 199) ** 2 - i / 199 + 0.5, 6) AS value FROM {_r(200)}",
    "perlin_noise": _perlin(40, 25, 42, 10.0, 4, 0.5, 2.0),
    "perlin_advanced": _perlin(33, 20, 7, 6.5, 3, 0.7, 3.0),
    "perlin_image": f"""
        SELECT y, x, trunc(value * 255)::INT AS byte, trunc(CASE WHEN value < 0.5 THEN 255 * (2 * value) ELSE 255 END)::INT AS red,
               trunc(CASE WHEN value < 0.5 THEN 255 * (2 * value) ELSE 255 + (0 - 255) * (2 * value - 1) END)::INT AS green FROM ({_NOISE})""",
    "image_solid": f"SELECT a.i AS y, b.i AS x, c::INT AS ch, [255, 128, 0][c + 1]::INT AS value FROM {_r(64)} a, {_r(64)} b, (SELECT unnest([0, 1, 2]) AS c)",
    "image_checkerboard": f"SELECT a.i AS y, b.i AS x, 0::INT AS ch, CASE WHEN (a.i // 8) % 2 = (b.i // 8) % 2 THEN 0 ELSE 255 END::INT AS value FROM {_r(64)} a, {_r(64)} b",
    "image_linear_gradient": f"SELECT a.i AS y, b.i AS x, c::INT AS ch, (CASE c WHEN 0 THEN 255 ELSE 100 END * b.i // 99)::INT AS value FROM {_r(50)} a, {_r(100)} b, (SELECT unnest([0, 1]) AS c)",
    "image_vertical_gradient": f"SELECT a.i AS y, b.i AS x, 0::INT AS ch, trunc(200 * (1 - a.i / 59) + 10 * (a.i / 59))::INT AS value FROM {_r(60)} a, {_r(20)} b",
    "image_angled_gradient": f"SELECT a.i AS y, b.i AS x, 0::INT AS ch, trunc(255 * least(1, (b.i * cos(pi() / 6) + a.i * 0.5::DOUBLE) / (64 * cos(pi() / 6) + 24)))::INT AS value FROM {_r(48)} a, {_r(64)} b",
    "image_radial_gradient": f"SELECT a.i AS y, b.i AS x, 0::INT AS ch, trunc(255 * least(1, sqrt((b.i - 25) ** 2 + (a.i - 40) ** 2) / sqrt(75 ** 2 + 40 ** 2)))::INT AS value FROM {_r(80)} a, {_r(100)} b",
    "image_cosine": f"""
        SELECT y, x, c::INT AS ch, trunc(greatest(0, least(255, round(v, 9))))::INT AS value FROM (
            SELECT y, x, 4096 / sqrt(32 * 64) + sum(a * sqrt(2 / 32) * sqrt(2 / 64) * cos(pi() / 32 * (y + 0.5) * ky) * cos(pi() / 64 * (x + 0.5) * kx)) AS v
            FROM ({_PIXELS}), (VALUES (1, 2, 900), (5, 3, -700)) k(ky, kx, a) GROUP BY y, x), (SELECT unnest([0, 1]) AS c)""",
    "image_unknown": f"SELECT a.i AS y, b.i AS x, c.i::INT AS ch, 128::INT AS value FROM {_r(4)} a, {_r(5)} b, {_r(3)} c",
    "normal_map": f"""
        WITH h AS (SELECT a.i AS y, b.i AS x, (a.i ** 2 + 3 * b.i) / 1024 AS h FROM {_r(32)} a, {_r(32)} b),
             d AS (SELECT c.y, c.x, 1.5 * (l.h - r.h) AS nx, 1.5 * (u.h - d.h) AS ny FROM h c JOIN h l ON l.y = c.y AND l.x = greatest(c.x - 1, 0) JOIN h r ON r.y = c.y AND r.x = least(c.x + 1, 31)
                   JOIN h u ON u.x = c.x AND u.y = greatest(c.y - 1, 0) JOIN h d ON d.x = c.x AND d.y = least(c.y + 1, 31))
        SELECT y, x, round(0.5 * (1 + nx / sqrt(1 + nx * nx + ny * ny)), 6) AS r, round(0.5 * (1 + ny / sqrt(1 + nx * nx + ny * ny)), 6) AS g, round(0.5 + 0.5 / sqrt(1 + nx * nx + ny * ny), 6) AS b FROM d""",
    "audio_adsr_sine": f"SELECT i, i // 300 AS chunk, c::INT AS ch, trunc(32767 * sin(2 * pi() * 440 * i / 8000) * {_ENVELOPE})::INT AS value FROM {_r(800)}, (SELECT unnest([0, 1]) AS c)",
    "audio_normalised": f"SELECT i, trunc(32767 * 0.9::DOUBLE * 0.5 * (sin(2 * pi() * 261.63::DOUBLE * i / 8000) + sin(2 * pi() * 329.63::DOUBLE * i / 8000)) * {_ENVELOPE} / 1.25)::INT AS value FROM {_r(800)}",
    "audio_silence": f"SELECT i, 0::INT AS value FROM {_r(50)}",
    "audio_noise": f"SELECT i AS chunk, 4000::BIGINT AS n, true AS centred, true AS spread FROM {_r(4)}",
    "video_keyframes": f"SELECT i AS frame, CASE WHEN i < 7 THEN 0 ELSE 1 END::INT AS keyframe, (i // 2)::INT AS dx, (-(i // 4))::INT AS dy FROM {_r(12)}",
    "video_pixels": f"""
        SELECT f.i AS frame, a.i AS y, b.i AS x, CASE WHEN b.i - f.i // 2 < 0 OR a.i + f.i // 4 > 15 THEN 0 WHEN f.i >= 7 THEN 9
            WHEN ((a.i + f.i // 4) // 4 + (b.i - f.i // 2) // 4) % 2 = 0 THEN 0 ELSE 255 END::INT AS value FROM {_r(12)} f, {_r(16)} a, {_r(24)} b""",
    "header_scan": """
        SELECT doc_id, 'archive' AS format, '1.1' AS version, 66::INT AS header_size, 'NUMPY_ARRAY' AS file_type, 'fallback_lzma' AS engine, 'LZMA_FALLBACK' AS payload_type, strlen(coalesce(text, '')) AS original_size,
               sha256(coalesce(text, '')) AS original_hash, 0::BIGINT AS flags, true AS whole FROM documents""",
    "archive_roundtrip": """
        SELECT doc_id, 'array' AS kind, strlen(coalesce(text, '')) AS n, coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), 0)::BIGINT AS total, 'uint8' AS dtype, NULL::VARCHAR AS error FROM documents""",
    "archive_info": """
        SELECT * FROM (VALUES ('a', 'image', 'IMAGE', 36::BIGINT, NULL), ('b', 'audio', 'AUDIO', 200, NULL), ('c', 'video', 'VIDEO', 120, NULL), ('d', 'texture', 'TEXTURE', 192, NULL), ('e', 'json', 'UNKNOWN_JSON', -1, NULL),
            ('f', 'small', NULL, -1, 'ValueError'), ('g', 'unknown', NULL, -1, 'ValueError')) t(path, format, file_type, original_size, error)""",
    "media_read": "SELECT DISTINCT user_id, 'image' AS kind, 60::BIGINT AS n, 3::INT AS channels, 20.0::DOUBLE * (user_id % 256 + 5) AS total FROM events",
    "coefficients_base64": "SELECT vec_id, (len(embedding) // 3 * 3)::INT AS n, round(list_sum(list_transform(embedding[1:len(embedding) // 3 * 3], lambda x: x::DOUBLE)), 5) AS total FROM embeddings",
}
