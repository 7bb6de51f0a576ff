"""Images, sound and video from parameters, one value at a time, and the formats they are written in.

Parameters are dictionaries as the JSON forms hold them. Missing keys take the defaults below; colours shorter than the
channels are filled with 0 (start) or 255 (end). Patterns that nothing is known of give grey 128 or silence.
"""

from __future__ import annotations

import base64
import io
import struct
import wave
from collections.abc import Iterator, Sequence

import numpy as np

# Defaults of the formats, the share of full scale after normalisation, PCM scale, samples of a chunk.
IMAGE = {"channels": 3, "color": (0, 0, 0), "gradient_start": (0, 0, 0), "gradient_end": (255, 255, 255), "gradient_angle": 0.0, "gradient_center": (0.5, 0.5), "pattern_scale": 1.0, "pattern_seed": 42, "dct_coefficients": (), "dct_coefficients_b64": None}
AUDIO = {"channels": 1, "frequencies": (), "envelope": (0.01, 0.1, 0.7, 0.2), "noise_amplitude": 0.0, "global_max_amplitude": None, "seed": 0}
HEADROOM, PCM, CHUNK, GREY = 0.9, 32767, 44_100, 128
#: Keyframe images that a video keeps; the oldest goes.
FRAME_CACHE = 10


def encode_coefficients(rows: Sequence[Sequence[float]]) -> str:
    """Rows of three doubles, little-endian, in base 64."""
    return base64.b64encode(np.asarray(rows, "<f8").tobytes()).decode()


def decode_coefficients(text: str, width: int = 3) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<f8").reshape(-1, width)


def _colour(given: Sequence[float], channels: int, fill: int) -> np.ndarray:
    return np.array([*given[:channels], *[fill] * (channels - len(given))], float)


def cosine_basis(n: int, k: np.ndarray) -> np.ndarray:
    """Orthonormal inverse cosine transform: row i of the basis vectors k."""
    scale = np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))
    return scale * np.cos(np.pi * (2 * np.arange(n)[:, None] + 1) * k / (2 * n))


def inverse_cosine(height: int, width: int, coefficients: np.ndarray) -> np.ndarray:
    """Sum of the cosines (y, x, value) that lie within the image; of two at one place the later one stays."""
    held = {(int(y), int(x)): v for y, x, v in coefficients if 0 <= int(y) < height and 0 <= int(x) < width}
    if not held:
        return np.zeros((height, width))
    y, x = (np.array([k[i] for k in held]) for i in (0, 1))
    return (cosine_basis(height, y) * np.array(list(held.values()))) @ cosine_basis(width, x).T


def image(params: dict) -> np.ndarray:
    """(height, width, channels) bytes."""
    p = IMAGE | {k: v for k, v in params.items() if v is not None}
    h, w, c = int(p["height"]), int(p["width"]), int(p["channels"])
    y, x = np.arange(h)[:, None], np.arange(w)[None, :]
    pattern = p["pattern"]
    if pattern == "solid_color":
        return np.broadcast_to(_colour(p["color"], c, 0).astype(np.uint8), (h, w, c)).copy()
    if pattern == "checkerboard":
        cell = max(int(p["pattern_scale"]), 1)
        first = ((x // cell + y // cell) % 2 == 0)[:, :, None]
        return np.where(first, _colour(p["color"], c, 0), _colour(p["gradient_end"], c, 255)).astype(np.uint8)
    if pattern in ("gradient_linear", "gradient_radial"):
        if pattern == "gradient_radial":
            cx, cy = p["gradient_center"][0] * w, p["gradient_center"][1] * h
            part = np.hypot(x - cx, y - cy) / max(np.hypot(max(cx, w - cx), max(cy, h - cy)), 1e-10)
        elif p["gradient_angle"] in (0, 90):
            part = (x / max(w - 1, 1) + 0 * y) if p["gradient_angle"] == 0 else (y / max(h - 1, 1) + 0 * x)
        else:
            nx, ny = np.cos(np.radians(p["gradient_angle"])), np.sin(np.radians(p["gradient_angle"]))
            part = (x * nx + y * ny) / max(w * abs(nx) + h * abs(ny), 1e-10)
        part = np.clip(part, 0, 1)[:, :, None]
        return np.clip(_colour(p["gradient_start"], c, 0) * (1 - part) + _colour(p["gradient_end"], c, 255) * part, 0, 255).astype(np.uint8)
    coefficients = decode_coefficients(p["dct_coefficients_b64"]) if p["dct_coefficients_b64"] else np.array(p["dct_coefficients"], float).reshape(-1, 3)
    if pattern in ("periodic", "unknown") and len(coefficients):
        grey = np.clip(inverse_cosine(h, w, coefficients), 0, 255).astype(np.uint8)
        return np.repeat(grey[:, :, None], c, axis=2)
    return np.full((h, w, c), GREY, np.uint8)


def texture(params: dict) -> np.ndarray:
    h, w = params.get("height", 256), params.get("width", 256)
    colour = params.get("color", [GREY] * 3) if params.get("texture_type", "solid") == "solid" else [GREY] * 3
    return np.broadcast_to(np.array(colour, np.uint8), (h, w, 3)).copy()


def envelope(at: np.ndarray, total: int, rate: int, adsr: Sequence[float]) -> np.ndarray:
    """Attack, decay, sustain and release at the sample positions `at` of a clip of `total` samples."""
    attack, decay, release = (int(adsr[i] * rate) for i in (0, 1, 3))
    level, start = adsr[2], max(0, total - release)
    rising = at / max(attack, 1)
    falling = 1 - (1 - level) * (at - attack) / max(decay, 1)
    closing = level * (1 - (at - start) / max(total - start, 1))
    return np.where(at < attack, rising, np.where(at < attack + decay, falling, np.where(at < start, level, closing)))


def pcm(samples: np.ndarray, loudest: float | None = None) -> np.ndarray:
    """16-bit samples, cut to full scale and towards zero; with `loudest` normalised to HEADROOM first."""
    scaled = samples / loudest * HEADROOM if loudest is not None and loudest > 0 else samples
    return np.trunc(np.clip(scaled, -1, 1) * PCM).astype(np.int16)


def _noise(at: np.ndarray, seed: int) -> np.ndarray:
    """Normal noise that depends on seed and position alone, so that chunks of any length agree."""
    mixed = (at.astype(np.uint64) * np.uint64(2) + np.arange(2, dtype=np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    u = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5
    u /= 2.0**53
    return np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])


def samples(params: dict, start: int, stop: int) -> np.ndarray:
    """Samples start to stop of a clip before PCM, with its envelope."""
    p = AUDIO | {k: v for k, v in params.items() if v is not None}
    at, rate = np.arange(start, stop), p["sample_rate"]
    total = int(p["duration"] * rate)
    if p["pattern"] in ("sine_wave", "multi_sine"):
        out = sum((a * np.sin(2 * np.pi * f * at / rate + ph) for f, a, ph in p["frequencies"]), np.zeros(len(at)))
    elif p["pattern"] == "noise_white":
        out = _noise(at, int(p["seed"])) * p["noise_amplitude"]
    else:
        return np.zeros(len(at))
    return out * envelope(at, total, rate, p["envelope"])


def audio_chunks(params: dict, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """16-bit samples in chunks, so that memory follows the chunk and not the clip; (n, channels) beyond one channel."""
    p = AUDIO | {k: v for k, v in params.items() if v is not None}
    total = int(p["duration"] * p["sample_rate"])
    for start in range(0, total, chunk):
        one = pcm(samples(p, start, min(start + chunk, total)), p["global_max_amplitude"])
        yield np.repeat(one[:, None], p["channels"], axis=1) if p["channels"] > 1 else one


def audio(params: dict) -> np.ndarray:
    return np.concatenate([np.zeros((0, params["channels"]) if params.get("channels", 1) > 1 else 0, np.int16), *audio_chunks(params)])


def wav(params: dict, chunk: int = CHUNK) -> bytes:
    """A 16-bit WAV file of a clip."""
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setparams((params.get("channels", 1), 2, params["sample_rate"], 0, "NONE", "not compressed"))
        for part in audio_chunks(params, chunk):
            file.writeframes(part.astype("<i2").tobytes())
    return out.getvalue()


def wav_float(values: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A WAV file of 32-bit floats: 44 bytes of header, then the samples."""
    data = np.asarray(values, "<f4").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 3, channels, rate, rate * channels * 4, channels * 4, 32, b"data", len(data)) + data


def keyframe_at(times: Sequence[float], t: float) -> int | None:
    """Index of the keyframe that holds at t: the last of those that come, in order, before the first later one; else the first."""
    if not times:
        return None
    later = next((i for i, time in enumerate(times) if time > t), len(times))
    return max(later - 1, 0)


def video_frames(params: dict) -> Iterator[np.ndarray]:
    """Frames of a video: its keyframes' images; with pattern slide they are shifted by whole pixels, black coming in."""
    h, w, fps = params["height"], params["width"], params["fps"]
    frames, moves = params.get("keyframes", []), params.get("motion_vectors", [])
    held: dict[int, np.ndarray] = {}
    for frame in range(int(params["duration"] * fps)):
        key = keyframe_at([t for t, _ in frames], frame / fps)
        if key is not None and key not in held:
            held[key] = image(frames[key][1])
            if len(held) > FRAME_CACHE:
                del held[next(iter(held))]
        base = np.zeros((h, w, 3), np.uint8) if key is None else held[key]
        if params["pattern"] == "slide" and moves:
            move = moves[min(frame, len(moves) - 1)]
            base = shifted(base, int(move["mean_dx"] * frame), int(move["mean_dy"] * frame))
        yield base


def shifted(raster: np.ndarray, dx: int, dy: int) -> np.ndarray:
    out, (h, w) = np.zeros_like(raster), raster.shape[:2]
    if abs(dx) < w and abs(dy) < h:
        out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = raster[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


# Fixed values of the noise: eight gradients, and the size of its table of permuted numbers.
_HALF = 0.7071067811865476
GRADIENTS = [(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0), (_HALF, _HALF), (-_HALF, _HALF), (_HALF, -_HALF), (-_HALF, -_HALF)]
TABLE = 256


def permutation(seed: int) -> np.ndarray:
    out = np.arange(TABLE)
    np.random.RandomState(seed).shuffle(out)
    return out


def fade(t: np.ndarray) -> np.ndarray:
    return t * t * t * (t * (t * 6 - 15) + 10)


def noise_2d(x: np.ndarray, y: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gradient noise at the points (x, y), about -1 to 1."""
    grad = np.array(GRADIENTS)
    fx, fy = x - np.floor(x), y - np.floor(y)
    ix, iy = np.trunc(x).astype(np.int64), np.trunc(y).astype(np.int64)

    def corner(dx: int, dy: int) -> np.ndarray:
        g = grad[table[(table[(ix + dx) % TABLE] + (iy + dy) % TABLE) % TABLE] % len(GRADIENTS)]
        return g[..., 0] * (fx - dx) + g[..., 1] * (fy - dy)

    u, v = fade(fx), fade(fy)
    low, high = (corner(0, d) * (1 - u) + corner(1, d) * u for d in (0, 1))
    return low * (1 - v) + high * v


def fractal_noise(x: np.ndarray, y: np.ndarray, table: np.ndarray, octaves: int, persistence: float = 0.5, lacunarity: float = 2.0) -> np.ndarray:
    """Octaves of noise over one another, divided by the sum of their amplitudes."""
    weights = persistence ** np.arange(octaves)
    return sum(weight * noise_2d(x * lacunarity**i, y * lacunarity**i, table) for i, weight in enumerate(weights)) / weights.sum()


def perlin(width: int, height: int, seed: int = 42, scale: float = 10.0, octaves: int = 4, persistence: float = 0.5, lacunarity: float = 2.0) -> np.ndarray:
    """(height, width) noise in 0 to 1."""
    if width < 1 or height < 1 or scale <= 0 or octaves < 1:
        raise ValueError("width, height and octaves must be 1 or more, scale above 0")
    x, y = np.meshgrid(np.arange(width) / scale, np.arange(height) / scale)
    return np.clip((fractal_noise(x, y, permutation(seed), octaves, persistence, lacunarity) + 1) / 2, 0, 1)


def to_bytes(values: np.ndarray) -> np.ndarray:
    """Values of 0 to 1 as bytes, cut towards zero."""
    return np.trunc(np.clip(values, 0, 1) * 255).astype(np.uint8)


def coloured(values: np.ndarray, palette: Sequence[Sequence[int]]) -> np.ndarray:
    """Colours between those of an evenly spaced palette."""
    colours, at = np.asarray(palette, float), np.clip(values, 0, 1)[..., None] * (len(palette) - 1)
    low = np.minimum(np.floor(at).astype(int)[..., 0], max(len(palette) - 2, 0))
    high = np.minimum(low + 1, len(palette) - 1)
    part = at - low[..., None]
    return np.trunc(colours[low] * (1 - part) + colours[high] * part).astype(np.uint8)


def normal_map(heights: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Unit normals by central differences, the border repeated, as colours in 0 to 1."""
    padded = np.pad(np.asarray(heights, float), 1, mode="edge")
    normal = np.stack([(padded[1:-1, :-2] - padded[1:-1, 2:]) * strength, (padded[:-2, 1:-1] - padded[2:, 1:-1]) * strength, np.ones(np.shape(heights))], axis=-1)
    return normal / np.linalg.norm(normal, axis=-1, keepdims=True) * 0.5 + 0.5
