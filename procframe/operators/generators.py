"""Generators as DataFrames: signals, noise, images, sound and video in long form, made by expressions alone.

Every builder starts from spark.range over positions, so a signal of any length or a raster of any size is made in
parallel without a shuffle; what depends on parameters (components, coefficients, keyframes, the permutation of the noise)
is a literal of the plan, as large as the parameters are. Values are doubles; colours are integers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media

TAU = 2 * np.pi


def positions(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i")


def raster(spark: SparkSession, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select((F.col("id") / width).cast("long").alias("y"), (F.col("id") % width).alias("x"))


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def _double(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def sine_value(i: Column, n: Column | int, frequency: Column | float, amplitude: Column | float = 1.0, phase: Column | float = 0.0, offset: Column | float = 0.0) -> Column:
    return _double(offset) + _double(amplitude) * F.sin(_double(frequency) * TAU * i / n + _double(phase))


def sine_wave(spark: SparkSession, n: int, frequency: float, amplitude: float = 1.0, phase: float = 0.0, offset: float = 0.0) -> DataFrame:
    """(i, value) of n samples over 0 to 1."""
    return positions(spark, n).select("i", sine_value(F.col("i"), n, frequency, amplitude, phase, offset).alias("value"))


def multi_sine(spark: SparkSession, n: int, components: Sequence[tuple[float, float, float]], offset: float = 0.0) -> DataFrame:
    """(i, value): the sum of components (frequency, amplitude, phase)."""
    waves = [sine_value(F.col("i"), n, *c) for c in components]
    return positions(spark, n).select("i", (_sum(waves) + F.lit(float(offset))).alias("value"))


def fourier(spark: SparkSession, n: int, terms: Sequence[tuple[int, float, float]], offset: float = 0.0) -> DataFrame:
    """(i, value): inverse transform of terms (bin, magnitude, phase), each below n / 2 with its mirror.

    A later term takes a bin, or a mirror's bin, from an earlier one; bins outside 0 to n - 1 count for nothing.
    """
    bins: dict[int, tuple[float, float]] = {}
    for k, magnitude, phase in terms:
        if 0 <= k < n:
            bins[k] = (magnitude, phase)
            if 0 < k < n // 2:
                bins[n - k] = (magnitude, -phase)
    waves = [F.lit(m / n) * F.cos(F.lit(TAU * k / n) * F.col("i") + F.lit(float(p))) for k, (m, p) in bins.items()]
    return positions(spark, n).select("i", (_sum(waves) + F.lit(float(offset))).alias("value"))


def horner(x: Column, coefficients: Sequence[float]) -> Column:
    """Highest degree first; no coefficient gives 0."""
    return reduce(lambda total, c: total * x + F.lit(float(c)), coefficients, F.lit(0.0))


def polynomial(spark: SparkSession, n: int, coefficients: Sequence[float]) -> DataFrame:
    """(i, value) at n points from 0 to 1, both ends included."""
    return positions(spark, n).select("i", horner(F.col("i") / F.lit(float(max(n - 1, 1))), coefficients).alias("value"))


def fade(t: Column) -> Column:
    return t * t * t * (t * (t * 6 - 15) + 10)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def gradient(code: Column, x: Column, y: Column) -> Column:
    """Dot product with the gradient of a code (0 to 7)."""
    parts = [F.element_at(F.array(*[F.lit(g[i]) for g in media.GRADIENTS]), code + 1) for i in (0, 1)]
    return parts[0] * x + parts[1] * y


def noise_value(x: Column, y: Column, table: Sequence[int]) -> Column:
    """Gradient noise at a point; the table permutes 0 to 255."""
    held, size = F.array(*[F.lit(int(v)) for v in table]), media.TABLE
    at = lambda i: F.element_at(held, (F.pmod(i, F.lit(size)) + 1).cast("int"))
    ix, iy, fx, fy = x.cast("int"), y.cast("int"), x - F.floor(x), y - F.floor(y)
    corner = lambda dx, dy: gradient(F.pmod(at(at(ix + dx) + F.pmod(iy + dy, F.lit(size))), F.lit(len(media.GRADIENTS))), fx - dx, fy - dy)
    rows = [lerp(corner(0, dy), corner(1, dy), fade(fx)) for dy in (0, 1)]
    return lerp(*rows, fade(fy))


def perlin(spark: SparkSession, width: int, height: int, seed: int = 42, scale: float = 10.0, octaves: int = 4, persistence: float = 0.5, lacunarity: float = 2.0) -> DataFrame:
    """(y, x, value) noise in 0 to 1: octaves of noise over one another."""
    if width < 1 or height < 1 or scale <= 0 or octaves < 1:
        raise ValueError("width, height and octaves must be 1 or more, scale above 0")
    table, points = media.permutation(seed).tolist(), raster(spark, height, width)
    weights = [persistence**k for k in range(octaves)]
    for k in range(octaves):  # a column for each octave keeps the generated code small
        grow = lacunarity**k
        points = points.withColumn(f"octave{k}", F.lit(weights[k]) * noise_value(F.col("x") / F.lit(float(scale)) * grow, F.col("y") / F.lit(float(scale)) * grow, table))
    mixed = (_sum([F.col(f"octave{k}") for k in range(octaves)]) / sum(weights) + 1) / 2
    return points.select("y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)).alias("value"))


def image(spark: SparkSession, params: dict) -> DataFrame:
    """(y, x, ch, value) of an image; the parameters are those of the JSON form."""
    p = media.IMAGE | {k: v for k, v in params.items() if v is not None}
    h, w, c = p["height"], p["width"], p["channels"]
    y, x, pattern = F.col("y").cast("double"), F.col("x").cast("double"), p["pattern"]
    colour = lambda key, fill: F.element_at(F.array(*[F.lit(float(v)) for v in [*p[key][:c], *[fill] * (c - len(p[key]))]]), F.col("ch") + 1)
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)).cast("int")
    coefficients = media.decode_coefficients(p["dct_coefficients_b64"]).tolist() if p["dct_coefficients_b64"] else p["dct_coefficients"]
    if pattern == "solid_color":
        value = colour("color", 0)
    elif pattern == "checkerboard":
        cell = max(int(p["pattern_scale"]), 1)
        value = F.when((F.floor(x / cell) + F.floor(y / cell)) % 2 == 0, colour("color", 0)).otherwise(colour("gradient_end", 255))
    elif pattern in ("gradient_linear", "gradient_radial"):
        if pattern == "gradient_radial":
            cx, cy = p["gradient_center"][0] * w, p["gradient_center"][1] * h
            part = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / max(float(np.hypot(max(cx, w - cx), max(cy, h - cy))), 1e-10)
        elif p["gradient_angle"] in (0, 90):
            part = x / max(w - 1, 1) if p["gradient_angle"] == 0 else y / max(h - 1, 1)
        else:
            nx, ny = (float(f(np.radians(p["gradient_angle"]))) for f in (np.cos, np.sin))
            part = (x * nx + y * ny) / max(w * abs(nx) + h * abs(ny), 1e-10)
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
        value = colour("gradient_start", 0) * (1 - part) + colour("gradient_end", 255) * part
    elif pattern in ("periodic", "unknown") and len(coefficients):
        held = {(int(ky), int(kx)): float(v) for ky, kx, v in coefficients if 0 <= int(ky) < h and 0 <= int(kx) < w}
        size = lambda k, n: float(np.sqrt((1 if k == 0 else 2) / n))
        waves = [F.lit(v * size(ky, h) * size(kx, w)) * F.cos((y * 2 + 1) * (np.pi * ky / (2 * h))) * F.cos((x * 2 + 1) * (np.pi * kx / (2 * w))) for (ky, kx), v in held.items()]
        value = F.round(_sum(waves), 9)  # sums that come out whole must not fall below
    else:
        value = F.lit(float(media.GREY))
    each = raster(spark, h, w).select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("ch"))
    return each.select("y", "x", "ch", cut(value).alias("value"))


def envelope(at: Column, total: int, rate: int, adsr: Sequence[float]) -> Column:
    """Attack, decay, sustain and release by the position in the whole clip."""
    attack, decay, release = (int(adsr[k] * rate) for k in (0, 1, 3))
    start = max(0, total - release)
    falling = 1 - (at - attack) * ((1 - adsr[2]) / max(decay, 1))
    closing = (1 - (at - start) / F.lit(float(max(total - start, 1)))) * adsr[2]
    return F.when(at < attack, at / F.lit(float(max(attack, 1)))).when(at < attack + decay, falling).when(at < start, F.lit(float(adsr[2]))).otherwise(closing)


def pcm(value: Column, loudest: float | None = None) -> Column:
    """16-bit samples, cut to full scale and towards zero."""
    scaled = value / loudest * media.HEADROOM if loudest is not None and loudest > 0 else value
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled)) * media.PCM).cast("int")


def noise(at: Column, seed: int) -> Column:
    """Normal noise by seed and position, the same however the positions are partitioned."""
    uniform = lambda part: (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), at, F.lit(part)), 11).cast("double") + 0.5) / 2.0**53
    return F.sqrt(F.log(uniform(0)) * -2) * F.cos(uniform(1) * TAU)


def audio(spark: SparkSession, params: dict, chunk: int = media.CHUNK) -> DataFrame:
    """(i, chunk, ch, value): 16-bit samples of a clip and the chunk they are delivered in."""
    p = media.AUDIO | {k: v for k, v in params.items() if v is not None}
    rate, at = p["sample_rate"], F.col("i")
    total = int(p["duration"] * rate)
    if p["pattern"] in ("sine_wave", "multi_sine"):
        sound = _sum([F.sin(at * (TAU * f / rate) + float(phase)) * float(a) for f, a, phase in p["frequencies"]])
    elif p["pattern"] == "noise_white":
        sound = noise(at, int(p["seed"])) * float(p["noise_amplitude"])
    else:
        sound = F.lit(0.0)
    value = pcm(sound * envelope(at, total, rate, p["envelope"]), p["global_max_amplitude"])
    one = positions(spark, total).select("i", F.floor(at / chunk).cast("long").alias("chunk"), value.alias("value"))
    return one.select("i", "chunk", F.explode(F.sequence(F.lit(0), F.lit(p["channels"] - 1))).alias("ch"), "value")


def keyframe_at(t: Column, times: Sequence[float]) -> Column:
    """Index of the keyframe that holds at t: the one before the first later one; null without keyframes."""
    if not times:
        return F.lit(None).cast("int")
    later = F.lit(len(times))
    for k in reversed(range(len(times))):
        later = F.when(F.lit(float(times[k])) > t, k).otherwise(later)
    return F.greatest(later - 1, F.lit(0))


def video_frames(spark: SparkSession, params: dict) -> DataFrame:
    """(frame, t, keyframe, dx, dy): what each frame shows, and how far pattern slide has moved it."""
    times, moves, fps = [t for t, _ in params.get("keyframes", [])], params.get("motion_vectors", []), float(params["fps"])
    frames = spark.range(int(params["duration"] * fps)).select(F.col("id").alias("frame"), (F.col("id") / fps).alias("t"))
    frames = frames.withColumn("keyframe", keyframe_at(F.col("t"), times))
    if params["pattern"] != "slide" or not moves:
        return frames.select("*", F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    at = (F.least(F.col("frame"), F.lit(len(moves) - 1)) + 1).cast("int")
    move = lambda key: (F.element_at(F.array(*[F.lit(float(m[key])) for m in moves]), at) * F.col("frame")).cast("int")
    return frames.select("*", move("mean_dx").alias("dx"), move("mean_dy").alias("dy"))


def video(spark: SparkSession, params: dict) -> DataFrame:
    """(frame, y, x, ch, value): keyframes are drawn once each, and frames look their pixels up; what slides in is black."""
    h, w = params["height"], params["width"]
    drawn = [image(spark, p).select(F.lit(k).alias("keyframe"), F.col("y").alias("ky"), F.col("x").alias("kx"), "ch", "value") for k, (_, p) in enumerate(params["keyframes"])]
    rasters = reduce(DataFrame.unionAll, drawn)
    pixels = F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("at")
    frames = video_frames(spark, params).repartition("frame").select("frame", "keyframe", "dx", "dy", pixels)
    frames = frames.select("frame", "keyframe", F.floor(F.col("at") / w).alias("y"), (F.col("at") % w).alias("x"), "dx", "dy")
    found = frames.withColumn("ky", F.col("y") - F.col("dy")).withColumn("kx", F.col("x") - F.col("dx"))
    found = found.withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(2)))).join(rasters, ["keyframe", "ky", "kx", "ch"], "left")
    return found.select("frame", "y", "x", "ch", F.coalesce("value", F.lit(0)).alias("value"))


def to_byte(value: Column) -> Column:
    """0 to 1 as a byte, cut towards zero."""
    return (F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * 255).cast("int")


def coloured(value: Column, palette: Sequence[Sequence[int]]) -> Column:
    """An array of colours between those of an evenly spaced palette."""
    top = len(palette) - 1
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * top
    low = F.least(F.floor(at), F.lit(max(top - 1, 0))).cast("int")
    colours = [F.array(*[F.lit(float(c[k])) for c in palette]) for k in range(len(palette[0]))]
    pick = lambda colour, i: F.element_at(colour, (F.least(i, F.lit(top)) + 1).cast("int"))
    return F.array(*[lerp(pick(c, low), pick(c, low + 1), at - low).cast("int") for c in colours])


def normal_map(heights: DataFrame, strength: float = 1.0) -> DataFrame:
    """(y, x, r, g, b) of heights (y, x, value): unit normals by central differences, the border repeated.

    The four neighbours of a cell come by equi-joins on (y, x), so no row or column of the raster is one task.
    """
    sides = {"left": (0, -1), "right": (0, 1), "up": (-1, 0), "down": (1, 0)}
    cells = heights.select(F.explode(F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(name).alias("side")) for name, (dy, dx) in {**sides, "own": (0, 0)}.items()])).alias("at"), "value")
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("value"))).alias(side)
    near = cells.select("at.*", "value").groupBy("y", "x").agg(*map(pick, [*sides, "own"])).where("own is not null")
    near = near.select("y", "x", *[F.coalesce(s, "own").alias(s) for s in sides])
    nx, ny = (F.col("left") - F.col("right")) * strength, (F.col("up") - F.col("down")) * strength
    near = near.select("y", "x", nx.alias("nx"), ny.alias("ny")).withColumn("length", F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + 1))
    shade = lambda v: v / F.col("length") * 0.5 + 0.5
    return near.select("y", "x", shade(F.col("nx")).alias("r"), shade(F.col("ny")).alias("g"), shade(F.lit(1.0)).alias("b"))
