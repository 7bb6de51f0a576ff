"""Exact deduplication by a Golomb-coded fingerprint exchange.

Each source chunk (a partition, or 2^20 rows of one) sorts its distinct 64-bit fingerprints, sends every owner of a hash
range the Rice-coded gaps, and receives one bit per fingerprint: set if another chunk sent it too. Rows whose bit is set,
or that repeat within their chunk, are suspects; only their texts are shuffled, and grouped by the bytes themselves.

Texts are equal when identical after deleting `[\\x20\\x09-\\x0D]`; null counts as empty. Of equal texts the row with the
most code points, then the smallest id, stays (null ids come last). Every input row gives one output row: repeated rows
each count. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, shuffle_partitions, small, with_group

BLANKS = b" \t\n\x0b\x0c\r"
CHUNK_ROWS = 1 << 20
#: Rows whose fingerprints one owner holds, about.
OWNED = 1 << 22
#: Suspect classes up to which their digests (32 bytes each) are broadcast to the second scan; beyond, a shuffled join.
BROADCAST_CLASSES = 1 << 19


def base(owner: int, owners: int) -> int:
    """The least fingerprint of an owner's range."""
    return -(-(owner << 32) // owners) << 32


def rice_encode(values: np.ndarray, start: int = 0) -> tuple[int, bytes]:
    """Rice code (a Golomb code with a power of two) of sorted distinct uint64 values from `start` on: (parameter, bytes).

    The quotients stand in unary in front, the remainders of k bits behind, each filled up to whole bytes.
    """
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(start)).astype(np.uint64)
    k = min(63, max(0, ((int(values[-1]) - start) // len(values)).bit_length() - 1))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(high), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def rice_decode(k: int, code: bytes, n: int, start: int = 0) -> np.ndarray:
    """The n values of rice_encode."""
    if not n:
        return np.zeros(0, np.uint64)
    behind = -(-n * k // 8)
    front = np.frombuffer(code, np.uint8, len(code) - behind)
    high = np.diff(np.flatnonzero(np.unpackbits(front))[:n], prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(code, np.uint8, behind, len(code) - behind))[: n * k].reshape(n, k)
    low = (rest.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    gaps = (high.astype(np.uint64) << np.uint64(k)) + low
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(start)


def normalised(texts: pa.Array) -> Iterator[bytes]:
    for x in texts:
        value = x.as_py()
        yield b"" if value is None else value.encode().translate(None, BLANKS)


FINGERPRINTS = "src long, owner int, rank long, repeated boolean, doc_id long, sha binary, n_points int, k int, n int, code binary"


def _send(batches: Iterator[pa.RecordBatch], owners: int) -> Iterator[pa.RecordBatch]:
    ids: list[pa.Array] = []
    digests: list[bytes] = []
    points: list[int] = []
    chunk = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal chunk
        if not digests:
            return
        src = (TaskContext.get().partitionId() << 24) + chunk
        chunk += 1
        fps = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
        values, inverse, counts = np.unique(fps, return_inverse=True, return_counts=True)
        owner = ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        first = np.searchsorted(owner, np.arange(owners, dtype=np.uint64))
        last = np.append(first[1:], len(values))
        n = len(fps)
        rank = np.arange(len(values)) - first[owner.astype(np.int64)]
        yield pa.record_batch(
            [
                pa.array(np.full(n, src)), pa.array(owner[inverse].astype(np.int32)), pa.array(rank[inverse]), pa.array(counts[inverse] > 1),
                pa.concat_arrays(ids), pa.array(digests, pa.binary()), pa.array(points, pa.int32()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
            ],
            names=[x.split()[0] for x in FINGERPRINTS.split(", ")],
        )
        sent = [o for o in range(owners) if last[o] > first[o]]
        codes = [rice_encode(values[first[o] : last[o]], base(o, owners)) for o in sent]
        m = len(sent)
        yield pa.record_batch(
            [
                pa.array(np.full(m, src)), pa.array(sent, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                pa.nulls(m, pa.int32()), pa.array([k for k, _ in codes], pa.int32()), pa.array([int(last[o] - first[o]) for o in sent], pa.int32()), pa.array([c for _, c in codes], pa.binary()),
            ],
            names=[x.split()[0] for x in FINGERPRINTS.split(", ")],
        )
        ids.clear(), digests.clear(), points.clear()

    for batch in batches:
        ids.append(batch.column(0).cast(pa.int64()))
        digests += [hashlib.sha256(x).digest() for x in normalised(batch.column(1))]
        points += [0 if x is None else x for x in batch.column(2).to_pylist()]
        if len(digests) >= CHUNK_ROWS:
            yield from flush()
    yield from flush()


def _answer(group: pa.Table, owners: int) -> pa.Table:
    """One owner: which of its fingerprints came from two chunks or more, as bits in each chunk's order."""
    start = base(group.column("owner")[0].as_py(), owners)
    parts = [rice_decode(k, code, n, start) for k, code, n in zip(*(group.column(c).to_pylist() for c in ("k", "code", "n")), strict=True)]
    values, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared, at, maps = counts[inverse] > 1, 0, []
    for part in parts:
        bits = np.packbits(shared[at : at + len(part)], bitorder="little").tobytes()
        maps.append(np.frombuffer(bits + bytes(-len(bits) % 8), "<i8").tolist())
        at += len(part)
    return pa.table({"src": group.column("src"), "owner": group.column("owner"), "bits": pa.array(maps, pa.list_(pa.int64()))})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = list(normalised(batch.column(1)))
        yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), batch.column(2).cast(pa.int32()), pa.array(texts, pa.binary())], names=["doc_id", "sha", "n_points", "body"])


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    owners = max(shuffle_partitions(spark), -(-docs.count() // OWNED))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.length(F.coalesce("text", F.lit(""))).alias("n_points"))
    sent = materialise(rows.mapInArrow(lambda batches: _send(batches, owners), FINGERPRINTS), "fingerprints")
    codes = sent.where("code is not null").select("src", "owner", "k", "n", "code")
    answers = codes.groupBy("owner").applyInArrow(lambda group: _answer(group, owners), "src long, owner int, bits array<long>")
    bit = F.getbit(F.element_at("bits", (F.shiftright("rank", 6) + 1).cast("int")), F.col("rank").bitwiseAND(63).cast("int"))
    flagged = sent.where("sha is not null").join(answers, ["src", "owner"]).select("doc_id", "sha", "n_points", (F.col("repeated") | (bit == 1)).alias("suspect"))
    flagged = materialise(flagged, "flagged")
    suspects = flagged.where("suspect").drop("suspect")
    classes = materialise(suspects.select("sha").distinct(), "classes")
    wanted = small(classes, classes.count(), BROADCAST_CLASSES)
    texts = rows.mapInArrow(_texts, "doc_id long, sha binary, n_points int, body binary").join(wanted, "sha", "left_semi")
    # most code points, then the smallest id, as one number: aggregates over numbers combine in each map task
    best = F.expr("cast(n_points AS decimal(10,0)) * 100000000000000000000BD + (9223372036854775807BD - cast(coalesce(doc_id, 9223372036854775807L) AS decimal(20,0)))")
    verified = texts.withColumn("best", best).groupBy("sha", "body").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("group_size"), F.count("doc_id").alias("with_id"))
    place = F.expr("9223372036854775807BD - best % 100000000000000000000BD")
    keepers = verified.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.max("best").alias("best"), F.max("group_size").alias("group_size"), F.max("with_id").alias("with_id"))
    keepers = keepers.select("sha", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts with one SHA-256"))).otherwise(F.when(F.col("with_id") > 0, place.cast("long"))).alias("keep_id"), "group_size")
    same = with_group(suspects, materialise(keepers, "keepers"), "sha", "group_size", suspects.count()).select("doc_id", "keep_id", "group_size", "sha", "n_points")
    alone = flagged.where("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha", "n_points")
    every = alone.union(same)
    return every.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_points")
