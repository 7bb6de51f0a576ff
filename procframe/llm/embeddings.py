"""Embedding near-duplicates by iterative quantisation.

Directions around their mean are rotated so that the signs of the components make a balanced code: each of TURNS rotations
is fitted by iterative quantisation from another start, on a bounded sample (SAMPLE vectors of one length). A code is cut
into SEGMENTS segments whose width follows the logarithm of the label's number of vectors, so that a key holds about as
many vectors whatever the size. Codes are indexed under each segment with one bit left out at a time: two vectors share a
key where a segment of theirs differs by one bit at most. Pairs that share one, and differ in less than FAR of all bits, are
reranked by cosine in double precision on the original vectors. The centre serves the code alone, and is left out where the
links among TRIED sampled vectors would be missed with it (vectors so close together that most are linked). In labels of
EXACT vectors or fewer all pairs are reranked.

Every usable vector is indexed: vectors of other lengths than the sample's commonest take random directions of their length,
uncentred. Equal vectors of a label are one node, counted by its size. Recall against brute force is in the tests.

Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label, link with nothing
and are components of their own; so does no vector with one of another length. Vectors are scaled by their largest component
first, so that no finite vector overflows. Repeated rows each count; rows without an id have no place in the order. Extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, materialise

SAMPLE, ROUNDS, TURNS = 20_000, 30, 2
SEGMENTS, NARROW, WIDE = 6, 6, 20
#: Share of differing bits from which a pair isn't reranked.
FAR = 0.3
EXACT, TRIED, WANTED = 256, 2000, 0.95


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def rotation(sample: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Projection of centred vectors to `bits` components by iterative quantisation."""
    start = np.random.default_rng(seed)
    basis = np.linalg.svd(sample, full_matrices=False)[2][:bits].T
    if basis.shape[1] < bits:  # fewer components than bits: more directions at random
        more = start.normal(size=(sample.shape[1], bits - basis.shape[1]))
        basis = np.concatenate([basis, more / np.linalg.norm(more, axis=0)], axis=1)
    v = sample @ basis
    r = np.linalg.qr(start.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        a, _, b = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (a @ b).T
    return basis @ r


class Coder:
    """Codes and keys of unit vectors; `held` is the number of vectors that a label may have, `threshold` the least cosine."""

    def __init__(self, sample: np.ndarray, held: int = 0, threshold: float = 0.98):
        self.width, self.bits = sample.shape[1], SEGMENTS * WIDE
        if not len(sample):
            return
        few = sample[:TRIED]
        a, b = np.nonzero(np.triu(few @ few.T >= threshold, 1))
        a, b = a[:TRIED], b[:TRIED]
        for share in (1.0, 0.0):
            self.centre = share * sample.mean(axis=0)
            each = -(-self.bits // TURNS)
            project = np.concatenate([rotation(sample - self.centre, each, turn) for turn in range(TURNS)], axis=1)[:, : self.bits]
            # bits of all rotations take turns, so that each segment mixes them
            self.project = project[:, np.argsort(np.arange(self.bits) % each, kind="stable")]
            w = int(segment_width(np.array([max(held, len(sample))]))[0])
            apart = (self.signs(few[a]) != self.signs(few[b]))[:, : SEGMENTS * w]
            met = (apart.reshape(-1, SEGMENTS, w).sum(axis=2) <= 1).any(axis=1) & (apart.sum(axis=1) < int(FAR * SEGMENTS * w))
            if met.sum() >= WANTED * len(a):
                break

    def signs(self, vectors: np.ndarray) -> np.ndarray:
        if vectors.shape[1] == self.width:
            return (vectors - self.centre) @ self.project >= 0
        return vectors @ np.random.default_rng(vectors.shape[1]).normal(size=(vectors.shape[1], self.bits)) >= 0


def segment_width(held: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(np.log2(np.maximum(held, 2))).astype(int), NARROW, WIDE)


def keys(signs: np.ndarray, width: int) -> np.ndarray:
    """Keys of each row: of SEGMENTS segments of `width` bits each one whole; then each one with each of its bits left out."""
    parts = signs[:, : SEGMENTS * width].reshape(-1, SEGMENTS, width).astype(np.int64) @ (1 << np.arange(width))
    left, segment = np.arange(width), np.arange(SEGMENTS)[:, None] * 64
    one_out = (parts[:, :, None] & ~(1 << left)) | ((segment + left) << WIDE)[None]
    return np.concatenate([parts | ((segment.ravel() + 63) << WIDE), one_out.reshape(len(signs), -1)], axis=1)


def near_duplicates(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    spark = rows.sparkSession
    bounded_batches(spark)
    vector = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    sound &= ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    keyed = materialise(every.withColumn("node", F.xxhash64("label", "v")), "vectors")
    groups = materialise(keyed.where("sound").groupBy("node", "label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first")), "groups")
    total = groups.count()
    if not total:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    share = min(1.0, SAMPLE / total)
    sample = groups.where(F.pmod(F.xxhash64(F.lit("rotation"), "node"), F.lit(1_000_000)) <= int(share * 1_000_000)).select("v").toPandas()["v"]
    width = int(np.bincount([len(x) for x in sample]).argmax()) if len(sample) else 0
    held = groups.groupBy("label", F.size("v").alias("length")).agg(F.count(F.lit(1)).alias("held"))
    most = held.agg(F.max("held")).first()[0]
    coder = Coder(unit(np.array([x for x in sample if len(x) == width], float).reshape(-1, width)), most, threshold)
    sized = groups.withColumn("length", F.size("v")).join(held, ["label", "length"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, lengths, held = batch.column(2).to_pylist(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            widths = np.where(held <= EXACT, 0, segment_width(held))
            for length, w in sorted(set(zip(lengths.tolist(), widths.tolist(), strict=True))):
                at = np.flatnonzero((lengths == length) & (widths == w))
                signs = coder.signs(unit(np.array([vectors[i] for i in at], float)))[:, : SEGMENTS * w]
                halves = np.packbits(np.pad(signs, ((0, 0), (0, 128 - signs.shape[1]))), axis=1).view(">i8").astype(np.int64)
                columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), batch.column(3).take(pa.array(at)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.full(len(at), int(FAR * SEGMENTS * w) if w else 129, np.int32)), pa.array(keys(signs, w).tolist() if w else [[-1]] * len(at), pa.list_(pa.int64()))]
                yield pa.record_batch(columns, names=["node", "label", "length", "low", "high", "far", "keys"])

    kind = dict(groups.dtypes)["label"]
    codes = materialise(sized.select("node", "label", "v", "length", "held").mapInArrow(code, f"node long, label {kind}, length int, low long, high long, far int, keys array<long>"), "codes")
    # the label, the length and the key in one number; what it wrongly joins, the label and the cosine tell apart
    index = codes.select("node", "low", "high", "far", F.xxhash64("label", "length").alias("group"), F.posexplode("keys").alias("place", "key")).withColumn("key", F.xxhash64("group", "key")).drop("group")
    a, b = index.alias("a"), index.alias("b")
    differs = f"getbit(CASE WHEN a.place < {64 + SEGMENTS} THEN a.low ^ b.low ELSE a.high ^ b.high END, 63 - (a.place - {SEGMENTS}) % 64) = 1"
    close = F.expr(f"a.key = b.key AND a.node < b.node AND bit_count(a.low ^ b.low) + bit_count(a.high ^ b.high) < a.far AND CASE WHEN a.place < {SEGMENTS} THEN true ELSE {differs} END")
    pairs = a.join(b, close).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(2)])
            for length in set(lengths.tolist()):
                part = batch.filter(pa.array(lengths == length))
                x, y = (unit(np.array(part.column(i).to_pylist(), float).reshape(-1, length)) for i in (2, 3))
                good = pa.array((x * y).sum(axis=1) >= threshold)
                yield pa.record_batch([part.column(0).filter(good), part.column(1).filter(good)], names=["a", "b"])

    left = groups.select(F.col("node").alias("a"), F.col("v").alias("x"), F.col("label").alias("of"))
    right = groups.select(F.col("node").alias("b"), F.col("v").alias("y"), F.col("label").alias("to"))
    both = pairs.join(left, "a").join(right, "b").where("of = to AND size(x) = size(y)")
    links = materialise(both.select("a", "b", "x", "y").mapInArrow(rerank, "a long, b long"), "links")
    ends = links.union(links.select("b", "a")).join(groups.select(F.col("node").alias("b"), "n"), "b")
    neighbours = ends.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("beside"))
    roots = components(links)
    rooted = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").join(neighbours, "node", "left").select("node", (F.coalesce("beside", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = keyed.where("sound").join(named, "node").select("vec_id", "n_links", "component_id")
    alone = keyed.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
