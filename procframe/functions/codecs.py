"""Byte codecs of whole values: LZ77 tokens, pair replacement, phrase lists, quantisers, residual containers, sub-bands.

Everything here works on one value in one task. DataFrame forms are in procframe.operators. Broken input raises
ValueError; nothing falls back to another codec without saying so.
"""

from __future__ import annotations

import json
import lzma
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

# Fixed values of the formats: the lossless marker; bits, minimum, scale and count ahead of quantised data; method names in
# the order in which the first of equal sizes is taken; the largest header of a container.
LOSSLESS, QUANTISED = 0xFF, struct.Struct("<BddI")
METHODS = ["none", "lzma", "zlib", "delta", "quantized"]
MAX_HEADER = 10 << 20
# Sub-band names with their quantisation strength and base ratio; LZMA preset by strength.
SUBBANDS = {"LLL": (1, 8.0), "LLH": (2, 4.0), "LHL": (2, 4.0), "HLL": (2, 4.0), "LHH": (4, 2.0), "HLH": (4, 2.0), "HHL": (4, 2.0), "HHH": (8, 1.2)}
PRESETS = {1: 6, 2: 5, 4: 3, 8: 1}

Token = tuple[int, int, int]


def lz77_encode(data: bytes, window: int = 4096, lookahead: int = 255) -> list[Token]:
    """(offset, length, literal): the longest match before the position, not into it; of equals the farthest back."""
    out, at, n = [], 0, len(data)
    while at < n:
        start, most = max(0, at - window), min(lookahead, n - at)
        length, found = 0, -1
        while length < most:
            # a longer match can't start before the place of the shorter one
            place = data.find(data[at : at + length + 1], start, at)
            if place < 0:
                break
            longest, length = min(most, at - place), length + 1
            while length < longest and data[place + length] == data[at + length]:
                length += 1
            found = start = place
        after = at + length
        out.append((at - found if length else 0, length, data[after] if after < n else 0))
        at = after + 1
    return out


def lz77_decode(tokens: Iterable[Token], n: int | None = None) -> bytes:
    """The bytes of the tokens; `n` of them, as the last literal stands for nothing where a match ends the data."""
    out = bytearray()
    for offset, length, literal in tokens:
        if length:
            if not 0 < offset <= len(out):
                raise ValueError(f"offset {offset} before the start")
            out += out[len(out) - offset : len(out) - offset + length]
        out.append(literal)
    return bytes(out if n is None else out[:n])


def replace_pair(data: bytes, pair: tuple[int, int], symbol: int) -> bytes:
    """From left to right, without overlaps."""
    return data.replace(bytes(pair), bytes([symbol]))


class PhraseList:
    """Distinct phrases in order of arrival, at most `capacity`; the oldest goes, and indices move up by one."""

    def __init__(self, capacity: int, phrases: Iterable[bytes] = ()):
        if capacity < 1:
            raise ValueError("a phrase list holds one phrase at least")
        self.capacity, self.gone = capacity, 0
        self.serial: dict[bytes, int] = {}
        for phrase in phrases:
            self.add(phrase)

    def add(self, phrase: bytes) -> int:
        """The phrase's index now."""
        if phrase not in self.serial:
            if len(self.serial) == self.capacity:
                del self.serial[next(iter(self.serial))]
                self.gone += 1
            self.serial[phrase] = self.gone + len(self.serial)
        return self.serial[phrase] - self.gone

    def lookup(self, index: int) -> bytes | None:
        held = self.phrases()
        return held[index] if 0 <= index < len(held) else None

    def phrases(self) -> list[bytes]:
        return list(self.serial)

    def __len__(self) -> int:
        return len(self.serial)


def recent_phrases(phrases: Iterable[bytes], capacity: int) -> list[bytes]:
    return PhraseList(capacity, phrases).phrases() if capacity > 0 else []


def quantise(values: np.ndarray, bits: int, rounding: str = "half_away") -> tuple[np.ndarray, float, float]:
    """(levels, minimum, scale); rounding is half_away, half_even or truncate. A range below 1e-10 has scale 1."""
    x = np.asarray(values, float)
    low, scale = (float(x.min()), float(np.ptp(x))) if x.size else (0.0, 1.0)
    scale = scale if scale >= 1e-10 else 1.0
    top = 2**bits - 1
    part = np.clip((x - low) / scale, 0, 1) * top
    levels = {"half_away": lambda: np.floor(part + 0.5), "half_even": lambda: np.rint(part), "truncate": lambda: np.trunc(part)}[rounding]()
    return levels.astype("u1" if bits == 8 else "<u2" if bits == 16 else "<u4"), low, scale


def dequantise(levels: np.ndarray, bits: int, low: float, scale: float) -> np.ndarray:
    return levels / (2**bits - 1) * scale + low


def pack_levels(values: np.ndarray, bits: int) -> bytes:
    """Minimum and scale as doubles, then the half-even levels in 1, 2 or 4 bytes each."""
    levels, low, scale = quantise(values, bits, "half_even")
    return struct.pack("<dd", low, scale) + levels.tobytes()


def unpack_levels(data: bytes, bits: int) -> np.ndarray:
    if len(data) < 16:
        raise ValueError("quantised data too short")
    return dequantise(np.frombuffer(data, "u1" if bits == 8 else "<u2" if bits == 16 else "<u4", offset=16), bits, *struct.unpack_from("<dd", data))


def _unlzma(data: bytes) -> bytes:
    try:
        return lzma.decompress(data)
    except lzma.LZMAError as error:
        raise ValueError(f"broken LZMA data: {error}") from error


def _unzlib(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error as error:
        raise ValueError(f"broken zlib data: {error}") from error


def lzma_compress(data: bytes, preset: int = 6, container: str = "xz") -> bytes:
    """An .xz stream, or with container "alone" a legacy .lzma one; lzma_decompress reads both."""
    return lzma.compress(data, format=lzma.FORMAT_ALONE if container == "alone" else lzma.FORMAT_XZ, preset=preset)


lzma_decompress, zlib_decompress = _unlzma, _unzlib


def zstd_compress(data: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def zstd_decompress(data: bytes) -> bytes:
    import zstandard

    try:
        return zstandard.ZstdDecompressor().decompress(data)
    except zstandard.ZstdError as error:
        raise ValueError(f"broken zstd data: {error}") from error


def pack_lossless(values: np.ndarray, preset: int = 6) -> bytes:
    return struct.pack("<BI", LOSSLESS, len(values)) + lzma_compress(values.astype("<f4").tobytes(), preset)


def unpack_lossless(data: bytes) -> np.ndarray:
    if len(data) < 5 or data[0] != LOSSLESS:
        raise ValueError("not a lossless residual")
    return np.frombuffer(_unlzma(data[5:]), "<f4", struct.unpack_from("<I", data, 1)[0])


def pack_quantised(values: np.ndarray, bits: int = 8, preset: int = 6) -> bytes:
    if bits not in (8, 16):
        raise ValueError("bits must be 8 or 16")
    levels, low, scale = quantise(values, bits)
    return QUANTISED.pack(bits, low, scale, len(values)) + lzma_compress(levels.tobytes(), preset)


def unpack_quantised(data: bytes) -> np.ndarray:
    if len(data) < QUANTISED.size:
        raise ValueError("quantised residual too short")
    bits, low, scale, n = QUANTISED.unpack_from(data)
    if bits not in (8, 16):
        raise ValueError(f"unknown bits {bits}")
    return dequantise(np.frombuffer(_unlzma(data[QUANTISED.size :]), f"<u{bits // 8}", n), bits, low, scale)


def pack_delta(values: np.ndarray, preset: int = 6) -> bytes:
    return lzma_compress(np.diff(values.astype("<f4"), prepend=np.float32(0)).astype("<f4").tobytes(), preset)


def unpack_delta(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(_unlzma(data), "<f4"), dtype="<f4")


@dataclass
class Residual:
    """A packed residual: method, payload, number of values, and what its method needs besides."""

    method: str
    payload: bytes
    n: int
    low: float = 0.0
    scale: float = 1.0
    bits: int = 8
    base: float = 0.0

    def to_bytes(self) -> bytes:
        """A 4-byte header length, the header as JSON, the payload."""
        more = {"quantized": {"min_val": self.low, "scale": self.scale, "bits": self.bits}, "delta": {"base_value": self.base}}
        header = json.dumps({"method": self.method, "original_len": self.n, "version": 2, **more.get(self.method, {})}, separators=(",", ":")).encode()
        return struct.pack("<I", len(header)) + header + self.payload

    @classmethod
    def from_bytes(cls, data: bytes) -> Residual:
        """Reads both header lengths: 4 bytes (version 2), else 2 bytes (version 1); a shape may stand for the count."""
        if len(data) < 4:
            raise ValueError(f"residual of {len(data)} bytes is too short")
        for form, least in (("<I", 2), ("<H", 0)):
            width = struct.calcsize(form)
            end = width + struct.unpack_from(form, data)[0]
            if end - width >= MAX_HEADER or end > len(data):
                continue
            try:
                header = json.loads(data[width:end])
            except ValueError:
                continue
            if isinstance(header, dict) and header.get("version", 1) >= least:
                return cls._of(header, data[end:])
        raise ValueError("no residual header")

    @classmethod
    def _of(cls, header: dict, payload: bytes) -> Residual:
        if header.get("method") not in [*METHODS, "zstd"]:
            raise ValueError(f"unknown residual method {header.get('method')!r}")
        shape = header.get("shape", [header.get("original_len")])
        if not isinstance(shape, list) or not all(isinstance(d, int) and d >= (0 if "original_len" in header else 1) for d in shape):
            raise ValueError(f"no valid shape: {shape!r}")
        get = lambda *names, default: next((header[k] for k in names if header.get(k) is not None), default)
        return cls(header["method"], payload, int(np.prod(shape)), get("min_val", default=0.0), get("scale", default=1.0), get("bits", "quant_bits", default=8), get("base_value", default=0.0))


def compress_residual(values: np.ndarray, method: str, bits: int = 8, preset: int = 6, level: int = 6) -> Residual:
    values = np.asarray(values)
    raw = values.astype("<f4").tobytes()
    if method == "quantized":
        _, low, scale = quantise(values, bits)
        return Residual(method, pack_quantised(values, bits, preset), len(values), low, scale, bits)
    pack = {"none": lambda: raw, "lzma": lambda: lzma_compress(raw, preset), "zlib": lambda: zlib.compress(raw, level), "zstd": lambda: zstd_compress(raw), "delta": lambda: pack_delta(values, preset)}
    if method not in pack:
        raise ValueError(f"unknown residual method {method!r}")
    return Residual(method, pack[method](), len(values), base=float(values[0]) if method == "delta" and len(values) else 0.0)


def decompress_residual(residual: Residual) -> np.ndarray:
    if not residual.n:
        return np.zeros(0)
    floats = lambda data: np.frombuffer(data, "<f4", residual.n)
    unpack = {
        "none": floats, "lzma": lambda d: floats(_unlzma(d)), "zlib": lambda d: floats(_unzlib(d)),
        "zstd": lambda d: floats(zstd_decompress(d)), "delta": unpack_delta, "quantized": unpack_quantised,
    }
    return unpack[residual.method](residual.payload)


def residual_sizes(values: np.ndarray) -> dict[str, int]:
    """Bytes each method takes, in the order in which the first of equals is taken."""
    return {method: len(compress_residual(values, method).payload) for method in METHODS}


def choose_residual(values: np.ndarray, lossy: bool = True) -> Residual:
    """Packed by the method of least size; without `lossy`, LZMA stands in for quantised data."""
    if not len(values):
        return Residual("none", b"", 0)
    sizes = residual_sizes(values)
    method = min(sizes, key=sizes.get)
    return compress_residual(values, "lzma" if method == "quantized" and not lossy else method)


def subband_settings(name: str) -> tuple[int, int]:
    """(bits, LZMA preset) of a sub-band: strong quantisation means fewer bits and less effort."""
    strength = SUBBANDS[name][0]
    return (16 if strength <= 2 else 8), PRESETS.get(strength, 4)


def compress_subband(coefficients: np.ndarray, name: str) -> bytes:
    bits, preset = subband_settings(name)
    return pack_quantised(np.asarray(coefficients).astype("<f4"), bits, preset)


def decompress_subband(data: bytes) -> np.ndarray:
    x = unpack_quantised(data)
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int32)
