"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has a bit set where over half of the XXH64 hashes (seed 42) of its 3-word shingles have it. Fingerprints
within 3 bits of each other are linked. Of two halves of 32 bits one then differs by at most one bit, so each
fingerprint is indexed under 64 signatures: a half with one of its bits left out. Fingerprints that share a signature
meet in an equality shuffle, are compared whole, and leave a spanning forest of the links found; components follow.

Only distinct fingerprints are indexed, so exact copies cost nothing. A signature of more than BLOCK fingerprints is
split into blocks, and each pair of blocks is a group of its own, so no task gets a group without bound.

Null and blank texts have fingerprint zero and are linked as any other. Rows may repeat; ids that are null have no place
in the order and take the component's least id, null if it has none. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, materialise, shuffle_partitions, small, with_group

SEED, WORDS, DISTANCE = 42, 3, 3
#: Fingerprints of one signature that are compared in one group.
BLOCK = 4096
#: Split signatures up to which their list (16 bytes each) is broadcast; beyond, a shuffled join.
BROADCAST_KEYS = 1 << 20


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    found = (text or "").encode().lower().split()  # bytes: A-Z alone, and exactly the six ASCII blanks
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest, seed = xxhash.xxh64_digest, SEED
    raw = np.frombuffer(b"".join([digest(x, seed) for x in shingles]), np.uint8)
    n = len(raw) // 8
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(raw[8 * at : 8 * (at + (1 << 16))]).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
        yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


_LANES, _ONES = np.arange(8, dtype=np.uint64)[:, None, None], np.uint64(0x0101010101010101)


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of 64 * words bits of a set of 64-bit hashes: a bit is 1 if set in over half of what the hashes are mixed to."""
    factors, addends = (np.random.default_rng(SEED).integers(0, 1 << 63, (words, 2), np.uint64) * 2 + 1).astype(np.uint64).T
    total = np.zeros((8, words, 8), np.int64)
    for at in range(0, len(hashes), 255):  # so many ones to a byte
        mixed = hashes[at : at + 255, None] * factors + addends
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        total += ((mixed >> _LANES) & _ONES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(8, words, 8)
    return np.packbits((2 * total > len(hashes)).transpose(1, 2, 0).reshape(-1))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a signed long."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _fingerprints(batches, words), "doc_id long, fp long")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between distinct fingerprints, in O(n) memory."""
    left, out = np.arange(len(fps)), []
    bits = fps.view(np.uint64)
    while len(left):  # grow one component after the other; each step looks at what no component holds yet
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= distance
            if near.any():
                new = left[near]
                out += [(int(fps[at]), int(fps[x])) for x in new]
                stack += new.tolist()
                left = left[~near]
    return out


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, part): links among the fingerprints of each run."""
    held_run, held = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)

    def of(runs: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]).any(axis=1)])) if len(runs) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(runs)))
        two = starts[sizes == 2]
        near = two[np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= distance]
        pairs = list(zip(fps[near].tolist(), fps[near + 1].tolist(), strict=True))
        for a, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            pairs += forest(np.unique(fps[a : a + m]), distance)
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        key, part, fp = (batch.column(i).to_numpy() for i in range(3))
        runs, fps = np.concatenate([held_run, np.stack([key, part], axis=1)]), np.concatenate([held, fp])
        if not len(runs):
            continue
        new = np.flatnonzero((runs != runs[-1]).any(axis=1))
        whole = int(new[-1]) + 1 if len(new) else 0
        yield from of(runs[:whole], fps[:whole])
        held_run, held = runs[whole:], fps[whole:]
    yield from of(held_run, held)


def signatures(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 keys for each fingerprint, half (1 bit), left-out bit (5), the half without it (32)."""
    each = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    half = F.when(F.col("i") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    left_out = F.expr("~shiftleft(1L, i % 32)")
    return each.select((F.shiftleft(F.col("i").cast("long"), 32) + half.bitwiseAND(left_out)).alias("key"), "fp")


def wildcards(rows: DataFrame, width: int) -> DataFrame:
    """rows (at, segment, ...) as (key, ...): `width` keys for each segment of so many bits, its place, a left-out bit, and what is left."""
    each = rows.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    place = F.shiftleft((F.col("at") * width + F.col("bit")).cast("long"), width)
    return each.withColumn("key", place + F.col("segment").bitwiseAND(F.expr("~shiftleft(1L, bit)"))).drop("at", "segment", "bit")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints `fps` to connect what links connect."""
    keys = signatures(fps.repartition(shuffle_partitions(fps.sparkSession), "fp"))  # each row becomes 64
    hot = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    dealt = keys.join(small(hot, hot.count(), BROADCAST_KEYS), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    sorted_ = dealt.select("key", part.alias("part"), "fp").repartition("key", "part").sortWithinPartitions("key", "part")
    return sorted_.mapInArrow(lambda batches: _links(batches, distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text)."""
    rows = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("held")), "distinct")
    roots = components(links(distinct.select("fp"), distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fp", "component_id", "held"), "named")
    return with_group(rows, named, "fp", "held", rows.count()).select("doc_id", "fp", "component_id")


def simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
