"""Byte strings: histograms, entropy, pair statistics, hashes, phrase lists, LZ77 and codecs over whole texts.

Statistics of one text run in Arrow batches, one output row a document, without a shuffle; a text must fit a worker. Null
text counts as empty.
"""

from __future__ import annotations

import hashlib
import lzma
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs

Query = Callable[[SparkSession, str], DataFrame]


def log2_series(p: np.ndarray, terms: int) -> np.ndarray:
    """log2 by the first terms of its odd power series in (p - 1) / (p + 1); falls short for small p."""
    y = (p - 1) / (p + 1)
    odd = 2 * np.arange(terms) + 1
    return 2 / math.log(2) * (y[..., None] ** odd / odd).sum(axis=-1)


def entropy(data: bytes, series_terms: int | None = None) -> float:
    """Shannon entropy in bits a byte; 0 for no bytes. With series_terms the logarithm is that many terms of its series."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / max(1, len(data))
    return float(-(p * (np.log2(p) if series_terms is None else log2_series(p, series_terms))).sum()) + 0.0


def least_size(data: bytes) -> int:
    """Bytes that entropy allows at least; sums within 1e-9 of a whole number count as that."""
    return math.ceil(round(entropy(data) * len(data) / 8, 9))


def top_pair(data: bytes) -> tuple[int, int, int] | None:
    """The commonest pair of neighbouring bytes and its count, at least 2; of equals the largest."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if len(raw) < 2:
        return None
    counts = np.bincount(raw[:-1] * 256 + raw[1:], minlength=65536)
    at = 65535 - int(np.argmax(counts[::-1]))
    return (at // 256, at % 256, int(counts[at])) if counts[at] >= 2 else None


def per_document(columns: str, f: Callable[[bytes], tuple]) -> Query:
    names = [x.split()[0] for x in columns.split(", ")]
    kinds = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[x.split()[1]] for x in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f((x or "").encode()) for x in batch.column(1).to_pylist()]
            found = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], names=["doc_id", *names])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        return docs.mapInArrow(run, f"doc_id long, {columns}")

    return query


def sha256_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha256"))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, b, n) for each byte that a text has."""
    counts = per_document("counts array<long>", lambda data: (np.bincount(np.frombuffer(data, np.uint8), minlength=256).tolist(),))
    return counts(spark, sf_dir).select("doc_id", F.posexplode("counts").alias("b", "n")).where("n > 0").select("doc_id", F.col("b").cast("long").alias("b"), "n")


def _replaced(data: bytes) -> tuple:
    found = top_pair(data)
    return len(data), len(codecs.replace_pair(data, found[:2], 255)) if found else len(data)


def _roundtrip(data: bytes) -> tuple:
    """Hashes of what four codecs give back."""
    back = [codecs.lzma_decompress(codecs.lzma_compress(data, 1)), codecs.lzma_decompress(codecs.lzma_compress(data, 1, "alone")), codecs.zlib_decompress(zlib.compress(data)), codecs.zstd_decompress(codecs.zstd_compress(data))]
    return (len(data), *(hashlib.sha256(x).hexdigest() for x in back))


def _lz77(data: bytes) -> tuple:
    tokens = codecs.lz77_encode(data)
    return len(data), hashlib.sha256(codecs.lz77_decode(tokens, len(data))).hexdigest(), len(tokens)


def _phrases(data: bytes) -> tuple:
    """A list of 1024 phrases and one of 16: how many they hold, and a hash of the last phrase's place by look-up."""
    words = data.split()
    large, small = codecs.PhraseList(1024, words), codecs.PhraseList(16, words)
    last = large.lookup(large.add(words[-1])) if words else b""
    return len(large), len(small), (last or b"").decode(errors="replace")


def lz77_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document("raw long, sha256 string, tokens long", _lz77)(spark, sf_dir).drop("tokens")


QUERIES: dict[str, Query] = {
    "byte_entropy": per_document("entropy double, n_bytes long", lambda data: (round(entropy(data), 6), len(data))),
    "byte_entropy_series": per_document("entropy double", lambda data: (round(entropy(data, 20), 5),)),
    "theoretical_minimum": per_document("least long", lambda data: (least_size(data),)),
    "byte_histogram": byte_histogram,
    "bpe_top_pair": per_document("a long, b long, n long", lambda data: top_pair(data) or (-1, -1, 0)),
    "bpe_replace": per_document("raw long, replaced long", _replaced),
    "phrase_dictionary": per_document("phrases long, recent long, last string", _phrases),
    "lz77_roundtrip": lz77_roundtrip,
    "lz77_tokens": per_document("raw long, tokens long", lambda data: (len(data), len(codecs.lz77_encode(data)))),
    "codec_roundtrip": per_document("raw long, xz string, alone string, zlib string, zstd string", _roundtrip),
    "codec_sizes": per_document("raw long, zlib long, lzma long", lambda data: (len(data), len(zlib.compress(data, 6)), len(lzma.compress(data, preset=6)))),
    "sha256_docs": sha256_docs,
}

_BYTES = "SELECT doc_id, generate_subscripts(b, 1) AS k, unnest(b) AS h FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents)"
_NUMBERS = f"SELECT doc_id, k, ('0x' || h)::BIGINT AS b FROM ({_BYTES})"
_COUNTS = f"SELECT doc_id, b, count(*) AS n FROM ({_NUMBERS}) GROUP BY doc_id, b"
_PAIRS = f"SELECT doc_id, b AS a, lead(b) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM ({_NUMBERS})"
_TOP = f"SELECT doc_id, arg_max(p, n * 65536 + p) AS p, max(n) AS n FROM (SELECT doc_id, a * 256 + b AS p, count(*) AS n FROM ({_PAIRS}) WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) GROUP BY doc_id"
# log2 by twenty terms of the series, as SQL
_SERIES20 = " + ".join(f"pow(y, {2 * k + 1}) / {2 * k + 1}" for k in range(20))
ORACLES: dict[str, str] = {
    "sha256_docs": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "byte_entropy": f"""
        SELECT d.doc_id, coalesce(e, 0) AS entropy, strlen(coalesce(text, '')) AS n_bytes FROM documents d LEFT JOIN (
            SELECT doc_id, round(-sum(c / n * log2(c / n)), 6) + 0 AS e FROM (
                SELECT doc_id, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS n FROM ({_BYTES}) GROUP BY doc_id, h
            ) GROUP BY doc_id) USING (doc_id)""",
    "byte_entropy_series": f"""
        SELECT doc_id, coalesce(e, 0) AS entropy FROM documents LEFT JOIN (
            SELECT doc_id, round(-sum(p * 2 / ln(2) * ({_SERIES20})), 5) + 0 AS e FROM (SELECT doc_id, p, (p - 1) / (p + 1) AS y FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM ({_COUNTS}))) GROUP BY doc_id) USING (doc_id)""",
    "theoretical_minimum": f"""
        SELECT doc_id, coalesce(least, 0) AS least FROM documents LEFT JOIN (
            SELECT doc_id, ceil(round((sum(n) * log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE))) / 8, 9))::BIGINT AS least FROM ({_COUNTS}) GROUP BY doc_id) USING (doc_id)""",
    "byte_histogram": _COUNTS,
    "bpe_top_pair": f"SELECT doc_id, coalesce(p // 256, -1) AS a, coalesce(p % 256, -1) AS b, coalesce(n, 0) AS n FROM documents LEFT JOIN ({_TOP}) USING (doc_id)",
    "bpe_replace": f"""
        WITH t AS ({_TOP}), s AS (SELECT doc_id, string_agg(chr((b + 1)::INT), '' ORDER BY k) AS s FROM ({_NUMBERS}) GROUP BY doc_id)
        SELECT d.doc_id, strlen(coalesce(text, '')) AS raw, CASE WHEN p IS NULL THEN strlen(coalesce(text, '')) ELSE length(replace(s, chr((p // 256 + 1)::INT) || chr((p % 256 + 1)::INT), '!')) END AS replaced
        FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "phrase_dictionary": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)
        SELECT doc_id, least(1024, len(list_distinct(w))) AS phrases, least(16, len(list_distinct(w))) AS recent, coalesce(w[-1], '') AS last FROM w""",
    "lz77_roundtrip": "SELECT doc_id, strlen(coalesce(text, '')) AS raw, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "codec_roundtrip": "SELECT doc_id, strlen(coalesce(text, '')) AS raw, sha256(coalesce(text, '')) AS xz, sha256(coalesce(text, '')) AS alone, sha256(coalesce(text, '')) AS zlib, sha256(coalesce(text, '')) AS zstd FROM documents",
}
