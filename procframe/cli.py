"""Command line: python -m procframe.cli compress|decompress|info|benchmark FILE [-o OUT].

Folders and globs go through Spark (one row a file); --short takes the 32-byte header's form.
"""

from __future__ import annotations

import argparse
import json
import lzma
import sys
import time
import zlib
from pathlib import Path

from .functions import codecs, media
from .sources import archive

SUFFIX = ".pfz"
#: Largest input of a benchmark.
MOST = 100 << 20


def compress_file(source: str, target: str | None = None, short: bool = False, lossless: bool = False) -> Path:
    data, out = Path(source).read_bytes(), Path(target) if target else Path(source).with_suffix(SUFFIX)
    out.write_bytes(archive.compress_short(data, lossless) if short else archive.compress(data))
    return out


def decompress_file(source: str, target: str | None = None) -> Path:
    data = Path(source).read_bytes()
    if data.startswith(archive.LAYOUT.short):
        ending, out = ".bin", archive.decompress_short(data)
    else:
        found = archive.decompress(data)
        if found.values is None:
            raise ValueError("frames of a video are made by procframe.operators.generators.video")
        ending = ".wav" if found.kind == "audio" else ".bin"
        out = media.wav(json.loads(data)["params"]) if found.kind == "audio" else found.values.tobytes()
    place = Path(target) if target else Path(source).with_suffix(ending)
    place.write_bytes(out)
    return place


def benchmark(source: str) -> list[dict]:
    """Size, ratio and time of zlib, LZMA and quantised zlib beside an archive."""
    data = Path(source).read_bytes()
    if len(data) > MOST:
        raise ValueError(f"{len(data)} bytes are too many for a benchmark")
    values = archive.load_values(data, source)
    raw = values.tobytes()
    ways = {
        "zlib": lambda: zlib.compress(raw, 6), "lzma": lambda: lzma.compress(raw, preset=6),
        "quantised_zlib": lambda: zlib.compress(codecs.quantise(values, 8)[0].tobytes(), 6), "archive": lambda: archive.compress(values),
    }
    out = []
    for name, way in ways.items():
        start = time.perf_counter()
        size = len(way())
        took = time.perf_counter() - start
        out.append({"method": name, "size": size, "ratio": len(raw) / size, "seconds": took, "mb_per_s": len(raw) / 1e6 / max(took, 1e-9)})
    return out


def convert_folder(source: str, target: str, back: bool = False) -> int:
    """Every file below source to an archive below target, or back, by Spark; the number of files."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .sources import datasource

    spark = SparkSession.builder.getOrCreate()
    datasource.register(spark)
    if back:
        rows = spark.read.format("procframe").load(source)
        rows.write.mode("overwrite").parquet(target)
        return spark.read.parquet(target).count()
    found = archive.files(spark, source)
    values = F.transform(F.sequence(F.lit(1), F.octet_length("content")), lambda i: F.conv(F.hex(F.substring("content", i, 1)), 16, 10).cast("double"))
    rows = found.select(F.concat(F.element_at(F.split("path", "/"), -1), F.lit(SUFFIX)).alias("path"), F.when(F.octet_length("content") > 0, values).otherwise(F.array().cast("array<double>")).alias("values"))
    rows.write.format("procframe").option("path", target).option("dtype", "uint8").mode("overwrite").save()
    return found.count()


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="procframe")
    parser.add_argument("command", choices=["compress", "decompress", "info", "benchmark"])
    parser.add_argument("file")
    parser.add_argument("-o", "--output")
    parser.add_argument("--short", action="store_true")
    parser.add_argument("--lossless", action="store_true")
    a = parser.parse_args(arguments)
    try:
        if Path(a.file).is_dir():
            print(convert_folder(a.file, a.output or f"{a.file}{SUFFIX}", a.command == "decompress"))
        elif a.command == "info":
            data = Path(a.file).read_bytes()
            print(json.dumps(archive.short_header(data) if data.startswith(archive.LAYOUT.short) else archive.info(data)))
        elif a.command == "benchmark":
            for row in benchmark(a.file):
                print(json.dumps(row))
        else:
            print(compress_file(a.file, a.output, a.short, a.lossless) if a.command == "compress" else decompress_file(a.file, a.output))
    except (OSError, ValueError, struct_error) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


struct_error = archive.struct.error

if __name__ == "__main__":
    sys.exit(main())
