"""Archives of modelled data: binary headers, payloads and JSON media forms, as values and as DataFrames.

An archive is a header of 66 bytes (version 1.1 on; 65 before, without a payload type) and a payload: parameters of a
generator as JSON, or LZMA data behind a JSON note of shape and type. Media are JSON objects with a magic string. A
Layout names the magics, so that files written under other names can be read too.

`scan` reads headers with Column expressions alone: no Python worker sees a payload. `read` decodes payloads in Arrow
batches; `write` packs series in Arrow batches into rows of bytes. Broken files give a row with `error` set, not a lost job.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, fits, media
from ..functions.registry import generate, validate_shape

# Fixed values of the format: sizes, enumerations by code, names of generator types, dtype of generated values, version.
V1, V2 = struct.Struct("<9s4BQQ32sI"), struct.Struct("<9s5BQQ32sI")
FILE_TYPES = {1: "NUMPY_ARRAY", 2: "IMAGE", 3: "AUDIO", 4: "TEXT", 5: "BINARY"}
ENGINES = ["procedural_generation", "neural_codec", "function_fitter", "fallback_lzma"]
PAYLOADS = {0x00: "PROCEDURAL", 0x10: "MEDIA_IMAGE", 0x11: "MEDIA_AUDIO", 0x12: "MEDIA_VIDEO", 0x20: "TEXTURE", 0x30: "LZMA_FALLBACK"}
GENERATED, VERSION, SMALLEST = "float32", (1, 1), 10
#: JSON and procedural payloads beyond this are refused.
MAX_JSON = 100 << 20


@dataclass(frozen=True)
class Layout:
    """Magic strings: nine bytes of a binary header, and those of the media forms."""

    magic: bytes = b"PROCFRAME"
    image: str = "PROC_IMG"
    audio: str = "PROC_AUD"
    video: str = "PROC_VID"
    texture: str = "PROC_TEX"
    short: bytes = b"PFZ\x01"

    def kinds(self) -> dict[str, str]:
        return {self.image: "image", self.audio: "audio", self.video: "video", self.texture: "texture"}


LAYOUT = Layout()


@dataclass(frozen=True)
class Header:
    version: tuple[int, int] = VERSION
    file_type: str = "NUMPY_ARRAY"
    engine: str = ENGINES[0]
    payload_type: str = "PROCEDURAL"
    original_size: int = 0
    compressed_size: int = 0
    original_hash: bytes = bytes(32)
    flags: int = 0
    size: int = V2.size


def pack_header(header: Header, layout: Layout = LAYOUT) -> bytes:
    """Always 66 bytes, of version 1.1 at least, so that it reads back as it was written."""
    codes = {name: code for code, name in FILE_TYPES.items()}, {name: code for code, name in PAYLOADS.items()}
    version = max(tuple(header.version), VERSION)
    return V2.pack(layout.magic, *version, codes[0][header.file_type], ENGINES.index(header.engine), codes[1][header.payload_type], header.original_size, header.compressed_size, header.original_hash, header.flags)


def unpack_header(data: bytes, layout: Layout = LAYOUT) -> Header:
    """An unknown payload type counts as PROCEDURAL; an unknown file type or engine is an error."""
    if len(data) < V1.size:
        raise ValueError(f"{len(data)} bytes are too short for a header")
    if data[:9] != layout.magic:
        raise ValueError("no archive: wrong magic")
    second = (data[9], data[10]) >= VERSION and len(data) >= V2.size
    form = V2 if second else V1
    _, major, minor, file_type, engine, *rest = form.unpack_from(data)
    payload = PAYLOADS.get(rest.pop(0), "PROCEDURAL") if second else "PROCEDURAL"
    if file_type not in FILE_TYPES or engine >= len(ENGINES):
        raise ValueError(f"unknown file type {file_type} or engine {engine}")
    return Header((major, minor), FILE_TYPES[file_type], ENGINES[engine], payload, *rest, form.size)


def _little_endian(content: Column, at: int, width: int) -> Column:
    digits = F.concat(*[F.hex(F.substring(content, at + 1 + i, 1)) for i in reversed(range(width))])
    return F.conv(digits, 16, 10).cast("decimal(20,0)" if width == 8 else "long")


def header_columns(content: Column, layout: Layout = LAYOUT) -> Column:
    """The header as a struct, null where there is none; decoded by expressions, for scans that leave payloads alone."""
    byte = lambda at: _little_endian(content, at, 1)
    second = (byte(9) * 256 + byte(10) >= 257) & (F.octet_length(content) >= V2.size)
    name = lambda code, names: F.element_at(F.create_map(*[F.lit(x) for pair in names for x in pair]), code.cast("int"))
    field_at = lambda at, width: F.when(second, _little_endian(content, at + 1, width)).otherwise(_little_endian(content, at, width))
    whole = (F.octet_length(content) >= V1.size) & (F.hex(F.substring(content, 1, 9)) == layout.magic.hex().upper())
    found = F.struct(
        F.concat_ws(".", byte(9), byte(10)).alias("version"), F.when(second, V2.size).otherwise(V1.size).alias("header_size"),
        name(byte(11), FILE_TYPES.items()).alias("file_type"), name(byte(12), enumerate(ENGINES)).alias("engine"),
        F.when(second, F.coalesce(name(byte(13), PAYLOADS.items()), F.lit("PROCEDURAL"))).otherwise(F.lit("PROCEDURAL")).alias("payload_type"),
        field_at(13, 8).alias("original_size"), field_at(21, 8).alias("compressed_size"),
        F.lower(F.hex(F.when(second, F.substring(content, 31, 32)).otherwise(F.substring(content, 30, 32)))).alias("original_hash"),
        field_at(61, 4).alias("flags"),
    )
    return F.when(whole, found)


def sniffed(content: Column, layout: Layout = LAYOUT) -> Column:
    """small, archive, image, audio, video, texture, short (the 32-byte header), json or unknown."""
    text = F.when(F.substring(F.hex(F.ltrim(F.substring(content, 1, 64).cast("string"))), 1, 2) == "7B", content.cast("string"))
    magic = F.get_json_object(text, "$.magic")
    kind = F.lit("json")
    for name, found in layout.kinds().items():
        kind = F.when(magic == name, found).otherwise(kind)
    starts = lambda x: F.hex(F.substring(content, 1, len(x))) == x.hex().upper()
    return F.when(F.octet_length(content) < SMALLEST, "small").when(text.isNotNull(), kind).when(starts(layout.magic), "archive").when(starts(layout.short), "short").otherwise("unknown")


def compress(values: np.ndarray | bytes | str, layout: Layout = LAYOUT, variant: str = "crossings") -> bytes:
    """An archive of the values: the parameters of a model within MAX_ERROR if that pays, else LZMA data."""
    array = values if isinstance(values, np.ndarray) else np.frombuffer(values.encode() if isinstance(values, str) else bytes(values), np.uint8)
    fit = fits.analyse(array.astype(float).ravel(), variant, array.itemsize) if array.size else fits.Fit("lzma")
    if fit.method == "lzma":
        note = json.dumps({"shape": list(array.shape), "dtype": str(array.dtype)}, separators=(",", ":")).encode()
        payload, kind, engine = struct.pack("<I", len(note)) + note + codecs.lzma_compress(array.tobytes()), "LZMA_FALLBACK", ENGINES[3]
    else:
        payload, kind, engine = pack_parameters(fit, array.shape, str(array.dtype)), "PROCEDURAL", ENGINES[0]
    header = Header(engine=engine, payload_type=kind, original_size=array.nbytes, compressed_size=len(payload), original_hash=hashlib.sha256(array.tobytes()).digest())
    return pack_header(header, layout) + payload


def pack_parameters(fit: fits.Fit, shape: tuple[int, ...], dtype: str, seed: int = 0) -> bytes:
    """The parameters of a fit as compact JSON."""
    c = fit.coefficients
    kind, parameters = {
        "sine": lambda: ("wave_function", dict(zip(["frequency", "amplitude", "phase", "dc_offset"], c, strict=True)) | {"is_simple_sine": True}),
        "fourier": lambda: ("fourier", {"coefficients": [[int(c[i]), c[i + 1], c[i + 2]] for i in range(0, len(c) - 1, 3)], "dc_offset": c[-1]}),
        "polynomial": lambda: ("polynomial", {"coefficients": c}),
    }[fit.method]()
    held = {"generator_type": kind, "seed": seed, "parameters": parameters, "output_shape": list(shape), "dtype": dtype}
    return json.dumps({"type": "generator", "params": held}, separators=(",", ":")).encode()


@dataclass
class Decoded:
    """kind: array, image, audio, video or texture. rate: of sound. parameters: of a video, whose frames are made apart."""

    kind: str
    values: np.ndarray | None
    rate: int | None = None
    parameters: dict | None = None


def _json(data: bytes) -> dict:
    if len(data) > MAX_JSON:
        raise ValueError(f"{len(data)} bytes of JSON are too many")
    try:
        found = json.loads(data.decode())
    except ValueError as error:
        raise ValueError(f"broken JSON: {error}") from error
    if not isinstance(found, dict):
        raise ValueError("JSON must be an object")
    return found


def _media(parsed: dict, layout: Layout) -> Decoded:
    kind = layout.kinds().get(parsed.get("magic", ""))
    if kind is None:
        raise ValueError(f"unknown media magic {parsed.get('magic')!r}")
    if kind == "video":
        return Decoded(kind, None, parameters=parsed)
    p = parsed.get("params", {})
    make = {"image": media.image, "audio": media.audio, "texture": media.texture}[kind]
    return Decoded(kind, make(p), p.get("sample_rate"))


def _from_lzma(data: bytes, shape: list[int] | None, dtype: str) -> Decoded:
    values = np.frombuffer(codecs.lzma_decompress(data), np.dtype(dtype))
    return Decoded("array", values if shape is None else values.reshape(shape))


def _procedural(parsed: dict) -> Decoded:
    if "type" not in parsed:
        raise ValueError("payload without type")
    if parsed["type"] != "generator":
        if not isinstance(parsed.get("data"), str):
            raise ValueError("LZMA payload without hexadecimal data")
        note = parsed.get("metadata", {})
        return _from_lzma(bytes.fromhex(parsed["data"]), note.get("shape"), note.get("dtype", GENERATED))
    p = parsed.get("params")
    missing = [k for k in ("generator_type", "seed", "parameters", "output_shape") if k not in (p or {})]
    if missing:
        raise ValueError(f"generator without {', '.join(missing)}")
    shape = validate_shape(p["output_shape"])
    return Decoded("array", generate(p["generator_type"], int(p["seed"]), p["parameters"], shape).astype(GENERATED))


def _with_note(data: bytes) -> Decoded:
    end = 4 + struct.unpack_from("<I", data)[0] if len(data) >= 4 else 4
    if len(data) < end:
        raise ValueError("LZMA payload cut short")
    note = _json(data[4:end])
    return _from_lzma(data[end:], note.get("shape", []), note.get("dtype", "uint8"))


def decompress(data: bytes, layout: Layout = LAYOUT, verify: bool = False) -> Decoded:
    """The values of an archive or JSON form. With `verify` LZMA data is held to the hash in the header."""
    if len(data) < SMALLEST:
        raise ValueError(f"{len(data)} bytes are no archive")
    if data.lstrip().startswith(b"{"):
        return _media(_json(data), layout)
    if not data.startswith(layout.magic):
        raise ValueError("unknown format")
    header = unpack_header(data, layout)
    payload = data[header.size :]
    if header.compressed_size > len(payload):
        raise ValueError(f"the header claims {header.compressed_size} bytes of payload, there are {len(payload)}")
    if header.payload_type == "LZMA_FALLBACK":
        found = _with_note(payload)
        if verify and hashlib.sha256(found.values.tobytes()).digest() != header.original_hash:
            raise ValueError("the values do not have the hash of the header")
        return found
    parsed = _json(payload)
    if header.payload_type == "PROCEDURAL":
        return _procedural(parsed)
    magic = {"MEDIA_IMAGE": layout.image, "MEDIA_AUDIO": layout.audio, "MEDIA_VIDEO": layout.video, "TEXTURE": layout.texture}
    return _media({**parsed, "magic": magic[header.payload_type]} if header.payload_type == "TEXTURE" else parsed, layout)


def info(data: bytes, layout: Layout = LAYOUT) -> dict:
    """What a file says of itself, without its values."""
    if len(data) < SMALLEST:
        raise ValueError(f"{len(data)} bytes are no archive")
    if data.startswith(layout.magic):
        h = unpack_header(data, layout)
        total = h.compressed_size + h.size
        try:
            parsed = json.loads(data[h.size :].decode())
        except ValueError:
            parsed = {"type": "binary"}
        return {
            "magic": layout.magic.decode(), "version": "{}.{}".format(*h.version), "header_version": 2 if h.size == V2.size else 1, "file_type": h.file_type, "engine": h.engine, "payload_type": h.payload_type,
            "payload_content_type": parsed.get("type", "unknown"), "original_size": h.original_size, "compressed_size": total, "file_size": len(data),
            "compression_ratio": h.original_size / total if h.original_size else 0.0, "original_hash": h.original_hash.hex(), "metadata": parsed.get("metadata", {}),
        }
    if not data.lstrip().startswith(b"{"):
        raise ValueError("unknown format")
    parsed = _json(data)
    kind, version = layout.kinds().get(parsed.get("magic", "")), parsed.get("version", [0, 0])
    p = parsed if kind == "video" else parsed.get("params", {})
    get = lambda k, default=0: p.get(k, default)
    sizes = {
        "image": lambda: get("width") * get("height") * get("channels", 3), "texture": lambda: get("width") * get("height") * 3,
        "audio": lambda: int(get("sample_rate") * get("duration") * get("channels", 1) * 2), "video": lambda: get("width") * get("height") * 3 * int(get("fps") * get("duration")),
    }
    size = parsed.get("original_size", sizes[kind]()) if kind in ("image", "audio") else sizes[kind]() if kind else None
    kinds = {"image": "IMAGE", "audio": "AUDIO", "video": "VIDEO", "texture": "TEXTURE"}
    types = {"image": "MEDIA_IMAGE", "audio": "MEDIA_AUDIO", "video": "MEDIA_VIDEO", "texture": "TEXTURE"}
    return {
        "magic": parsed.get("magic", "UNKNOWN"), "version": ".".join(map(str, version[:2])) if isinstance(version, list) and len(version) > 1 else str(version), "file_type": kinds.get(kind, "UNKNOWN_JSON"),
        "engine": "unknown" if kind is None else "procedural_texture" if kind == "texture" else "media_procedural", "payload_type": types.get(kind, "unknown"), "pattern": get("texture_type" if kind == "texture" else "pattern", "unknown"),
        "original_size": size, "compressed_size": len(data), "compression_ratio": size / len(data) if size else 0.0, "metadata": p,
    }


# The short archive: 32 bytes of header, then zlib data, quantised or as it is. Modes by code.
SHORT = struct.Struct("<4s4B4IQ")
MODES = {0: "raw", 1: "polynomial", 2: "fourier", 3: "perlin", 10: "quantized8", 11: "quantized16", 20: "lossless"}


def compress_short(data: bytes, lossless: bool = False, raw: bool = False, level: int = 6, layout: Layout = LAYOUT) -> bytes:
    """Whole 32-bit floats become 8-bit levels unless `lossless` or `raw`; other bytes are kept as they are."""
    if raw or lossless or len(data) % 4 or not data:
        mode, payload = (0 if raw else 20), codecs.zlib.compress(data, level)
    else:
        levels, low, scale = codecs.quantise(np.frombuffer(data, "<f4"), 8)
        mode, payload = 10, struct.pack("<dd", low, scale) + codecs.zlib.compress(levels.tobytes(), level)
    return SHORT.pack(layout.short, 1, mode, 0, 1, len(data) // 4, 0, 0, 0, len(data)) + payload


def short_header(data: bytes, layout: Layout = LAYOUT) -> dict:
    """Unknown modes count as raw."""
    if len(data) < SHORT.size or data[:4] != layout.short:
        raise ValueError("no short archive")
    _, version, mode, dtype, ndim, *shape, size = SHORT.unpack_from(data)
    return {"version": version, "mode": MODES.get(mode, "raw"), "dtype": dtype, "ndim": ndim, "shape": shape, "original_size": size, "ratio": size / len(data)}


def decompress_short(data: bytes, layout: Layout = LAYOUT) -> bytes:
    header, payload = short_header(data, layout), data[SHORT.size :]
    if header["mode"] in ("raw", "lossless"):
        return codecs.zlib_decompress(payload)
    if not header["mode"].startswith("quantized"):
        raise ValueError(f"mode {header['mode']} can't be read")
    if len(payload) < 16:
        raise ValueError("payload too short")
    low, scale = struct.unpack_from("<dd", payload)
    return codecs.dequantise(np.frombuffer(codecs.zlib_decompress(payload[16:]), np.uint8), 8, low, scale).astype("<f4").tobytes()


def load_values(data: bytes, name: str = "") -> np.ndarray:
    """Values of a file: .npy, numbers in text between blanks, else its bytes; names that end in .f32 hold floats."""
    if data.startswith(b"\x93NUMPY"):
        import io

        return np.load(io.BytesIO(data), allow_pickle=False)
    if name.endswith(".f32"):
        return np.frombuffer(data[: len(data) // 4 * 4], "<f4")
    try:
        words = data.decode().split()
        return np.array([float(w) for w in words]) if words else np.frombuffer(data, np.uint8)
    except ValueError:
        return np.frombuffer(data, np.uint8)


VALUES = "path string, kind string, n long, shape array<int>, dtype string, rate int, values array<double>, error string"


def _decoded(batches: Iterator[pa.RecordBatch], layout: Layout, verify: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in VALUES.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                found, data = None, content.as_py() or b""
                found = Decoded("array", np.frombuffer(decompress_short(data, layout), np.uint8)) if data.startswith(layout.short) else decompress(data, layout, verify)
                v, error = found.values, None
            except (ValueError, KeyError, TypeError, struct.error) as problem:
                v, error = None, str(problem)
            row = [path, found.kind if found else None, None if v is None else v.size, None if v is None else list(v.shape), None if v is None else str(v.dtype), found.rate if found else None, None if v is None else v.ravel().astype(float), error]
            yield pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)


def read(files: DataFrame, layout: Layout = LAYOUT, verify: bool = False) -> DataFrame:
    """path, kind, n, shape, dtype, rate, values, error for files (path, content), as of spark.read.format("binaryFile")."""
    return files.select("path", "content").mapInArrow(lambda batches: _decoded(batches, layout, verify), VALUES)


def scan(files: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """path, format, file_size, the header's fields and the ratio, without Python workers."""
    found = files.select("path", sniffed(F.col("content"), layout).alias("format"), F.octet_length("content").cast("long").alias("file_size"), header_columns(F.col("content"), layout).alias("h"))
    total = F.col("h.compressed_size") + F.col("h.header_size")
    ratio = F.when((total > 0) & (F.col("h.original_size") > 0), F.col("h.original_size").cast("double") / total.cast("double")).otherwise(F.when(F.col("h").isNotNull(), F.lit(0.0)))
    return found.select("path", "format", "file_size", "h.*", ratio.alias("compression_ratio"))


def _packed(batches: Iterator[pa.RecordBatch], layout: Layout, dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [None if not x.is_valid else compress(np.array(x.as_py(), float).astype(dtype), layout) for x in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], names=["path", "content"])


def pack(series: DataFrame, layout: Layout = LAYOUT, dtype: str = "float64") -> DataFrame:
    """(path, content): an archive of each row of series (path, values array<double>); null values give a null content."""
    return series.select(F.col("path").cast("string").alias("path"), F.col("values").cast("array<double>")).mapInArrow(lambda batches: _packed(batches, layout, dtype), "path string, content binary")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def with_magic(magic: bytes, media_prefix: str, short: bytes = LAYOUT.short) -> Layout:
    """A layout under another name: nine bytes, and the media magics' common start."""
    if len(magic) != 9 or len(short) != 4:
        raise ValueError("a magic has 9 bytes, a short one 4")
    return replace(LAYOUT, magic=magic, short=short, **{kind: media_prefix + end for kind, end in (("image", "IMG"), ("audio", "AUD"), ("video", "VID"), ("texture", "TEX"))})
