"""Near copies by 5-word shingles: pairs of a Jaccard similarity of at least 0.8, found by SimHash and verified.

A text is the set of XXH64 hashes (seed 42) of its shingles, cut as op6 cuts them. Texts with equal sets are one node.
Each node has a SimHash, longer than op6's: sets of Jaccard 0.8 differ in a share DIFFER of its bits, so that of 64 bits some
10 would differ, and up to 17. It is cut into segments as op6 cuts its into halves, each is indexed under every way to leave
one bit out, and nodes that share such a signature meet in an equality shuffle. The width of a segment goes with the number of
rows, so that few others share a signature by chance, and the number of segments with the width: a pair of 0.8 has over one
differing bit in all of them with probability MISS, and less above.

Every link is verified on the whole sets, and only if word by word of the SimHash no more bits differ than 5 deviations allow.
Of a signature that up to FEW nodes share all pairs are tested. Of others a first round tests the nodes against one hub,
another for each key; what then hangs together needs no more tests. A second round tests all pairs of such a key that are
still apart. A key of more than BLOCK nodes is cut into blocks, and each pair of blocks is a group of its own. Linked nodes
are one component.

Null and blank texts are one node. Rows may repeat; ids that are null have no place in the order. `near_copies` ignores extra
columns; `keep_one` passes them on. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, materialise, setting, small, with_group
from .simhash import SEED, wide_fingerprint, wildcards

WORDS = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Least Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Share of bits in which the SimHashes of two such sets differ: the angle of vectors of cosine 8/9 over pi.
DIFFER = math.acos(8 / 9) / math.pi
#: Share of pairs of SIMILAR that no segment may find.
MISS = 0.005
#: Words of the SimHash by which nodes of a key are told apart, and the bytes of one.
BANDS, ROWS = 8, 8
#: Bits that may differ in all those words, and in the first alone.
FAR, FAR_WORD = (int(bits * DIFFER + 5.5 * math.sqrt(bits * DIFFER * (1 - DIFFER))) for bits in (64 * BANDS, 64))
#: Nodes of one key that are all compared at once.
FEW = 16
#: Nodes of one key that are compared in one group.
BLOCK = 4096
#: Keys up to which their list is broadcast; beyond, a shuffled join.
BROADCAST_KEYS = 1 << 19
#: Signatures (24 bytes each) to a node that are shuffled at once; small tables shuffle theirs in fewer rounds.
AT_ONCE = 100
#: Signatures to an Arrow batch; they have a fixed length.
KEY_ROWS = 20_000


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a text of fewer words is one shingle, one of none has none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(found)] if len(found) <= words else map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.unique(np.fromiter((digest(x, seed) for x in shingles), np.uint64))


def cut(rows: int) -> tuple[int, int]:
    """Width and number of segments for a table of so many rows."""
    width = min(28, max(16, math.ceil(math.log2(max(2, rows))) + 2))
    found = (1 - DIFFER) ** width + width * DIFFER * (1 - DIFFER) ** (width - 1)
    return width, math.ceil(math.log(MISS) / math.log(1 - found))


def segments(bits: np.ndarray, width: int, count: int) -> np.ndarray:
    """The first `count` segments of a SimHash of single bits."""
    return bits[: width * count].reshape(count, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have at least SIMILAR of their union in common."""
    part, whole = SIMILAR
    if min(len(a), len(b)) * whole < part * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * whole >= part * (len(a) + len(b) - common)


def _prints(batches: Iterator[pa.RecordBatch], width: int, count: int) -> Iterator[pa.RecordBatch]:
    words = max(BANDS, -(-width * count // 64))
    for batch in batches:
        node, size, keys, sketch = [], [], [], []
        for text in batch.column(2):
            found = shingle_set(text.as_py())
            print_ = wide_fingerprint(found, words)
            node.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            size.append(len(found))
            keys.append(segments(np.unpackbits(print_), width, count))
            sketch.append(print_[-BANDS * ROWS :].tobytes())
        segment = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()), count).cast(pa.list_(pa.int64()))
        columns = [batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), segment, pa.array(sketch, pa.binary())]
        yield pa.record_batch(columns, names=["doc_id", "hash", "node", "size", "segments", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([shingle_set(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], names=["node", "found"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, binary ones as rows of bytes, such that runs of equal values in the first `by` are whole."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]
        columns = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
        new = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns[:by]]))
        whole = int(new[-1]) + 1 if len(new) else 0
        if whole:
            yield [c[:whole] for c in columns]
        held = [c[whole:] for c in columns]
    if held:
        yield held


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key: pairs (x, y) of nodes that share it and may be similar; of keys of over FEW nodes (key, node) and the pairs with the hub."""
    names = ["key", "x", "y"]

    def near(word: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count((word[i] ^ word[j]).view(np.uint64)) <= FAR_WORD

    for key, node, word in _runs(batches, 1):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        many = np.repeat(sizes > FEW, sizes)
        out = []
        for lag in range(1, min(FEW, int(sizes.max()))):
            i = np.flatnonzero((key[lag:] == key[:-lag]) & ~many[lag:])
            out.append((i, i + lag))
        for at, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            hub = at + int(((node[at : at + n] ^ key[at]).view(np.uint64) * _MIX).argmin())
            out.append((np.delete(np.arange(at, at + n), hub - at), np.full(n - 1, hub)))
        for i, j in out:
            good = near(word, i, j)
            a, b = node[i[good]], node[j[good]]
            if len(a):
                yield pa.record_batch([pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=names)
        if many.any():
            yield pa.record_batch([pa.array(key[many]), pa.array(node[many]), pa.nulls(int(many.sum()), pa.int64())], names=names)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, part): pairs of each run that are of two components and may be similar."""
    for key, part, nodes, rooted, sizes, sketch in _runs(batches, 2):
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        words = np.ascontiguousarray(sketch).view(np.uint64)
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
            node, root, size, seen = nodes[at:end], rooted[at:end], sizes[at:end], words[at:end]
            roots, counts = np.unique(root, return_counts=True)
            largest = roots[counts.argmax()]
            for i in np.flatnonzero(root != largest).tolist():  # of two outside the largest component, the lesser node asks
                ask = (root != root[i]) & ((root == largest) | (node > node[i]))
                ask &= np.minimum(size, size[i]) * SIMILAR[1] >= SIMILAR[0] * np.maximum(size, size[i])
                js = np.flatnonzero(ask)
                js = js[np.bitwise_count(seen[js] ^ seen[i]).sum(axis=1) <= FAR]
                if len(js):
                    a, b = np.minimum(node[js], node[i]), np.maximum(node[js], node[i])
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, n, node, ...) with the pair of blocks they are compared in."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("bigint")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.withColumn("part", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))


def links(docs: DataFrame, prints: DataFrame, width: int, count: int) -> DataFrame:
    """(a, b): enough verified links between the nodes of `prints` to connect what links connect."""
    spark = docs.sparkSession
    words = [F.conv(F.hex(F.substring("sketch", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"w{i}") for i in range(BANDS)]
    nodes = materialise(prints.groupBy("node").agg(F.min("hash").alias("hash"), F.first("size").alias("size"), F.first("segments").alias("segments"), F.first("sketch").alias("sketch")).select("*", *words), "nodes")
    total = nodes.count()
    step = max(1, AT_ONCE * max(1 << 18, total) // max(1, total * width))
    met = None
    for at in range(0, count, step):  # some segments at a time, so that the shuffle's files stay few times the input
        each = nodes.select("node", F.col("w7").alias("word"), F.posexplode(F.slice("segments", at + 1, step)).alias("at", "segment")).withColumn("at", F.col("at") + at)
        keys = wildcards(each, width).select("key", "node", "word").repartition("key").sortWithinPartitions("key")
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(KEY_ROWS)):
            found = materialise(keys.mapInArrow(_met, "key long, x long, y long"), "met")
        met = found if met is None else met.union(found)
    members = met.where("key is not null").selectExpr("key", "x AS node")

    def near(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose sizes and SimHashes allow that they are similar."""
        x, y = (nodes.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), *[F.col(f"w{i}").alias(f"{k}{i}") for i in range(BANDS)]) for k in "ab")
        differ = " + ".join(f"bit_count(a{i} ^ b{i})" for i in range(BANDS))
        part, whole = SIMILAR
        return materialise(pairs.join(x, "a").join(y, "b").where(f"least(a_size, b_size) * {whole} >= {part} * greatest(a_size, b_size) AND {differ} <= {FAR}").select("a", "b"), name)

    tested = near(met.where("key is null").selectExpr("x AS a", "y AS b").distinct(), "tested")
    asked = tested.select(F.col("a").alias("node")).union(tested.select("b")).union(members.select("node")).distinct()
    texts = docs.select(F.xxhash64("text").alias("hash"), "text").join(nodes.join(asked, "node", "left_semi").select("hash", "node"), "hash").dropDuplicates(["node"])
    bounded_batches(spark)
    sets = materialise(texts.select("node", "text").mapInArrow(_sets, "node long, found binary"), "sets")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
        return materialise(both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), name)

    first = verify(tested, "first")
    if members.isEmpty():
        return first
    rooted = members.join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialise(rooted, "rooted")
    still = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("key", "n")
    still = materialise(still, "still")
    left = rooted.join(small(still, still.count(), BROADCAST_KEYS), "key").join(nodes.select("node", "size", "sketch"), "node")
    sorted_ = _dealt(left).select("key", "part", "node", "root", F.col("size").cast("long").alias("size"), "sketch").repartition("key", "part").sortWithinPartitions("key", "part")
    apart = sorted_.mapInArrow(_apart, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti")
    return first.union(verify(materialise(apart, "apart"), "second"))


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, component) of every row of docs, written."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    width, count = cut(docs.count())
    prints = materialise(rows.mapInArrow(lambda batches: _prints(batches, width, count), "doc_id long, hash long, node long, size int, segments array<long>, sketch binary"), "prints")
    roots = materialise(components(links(docs, prints, width, count)).withColumnRenamed("root", "component"), "roots")  # linked nodes alone
    held = roots.join(prints.groupBy("node").agg(F.count(F.lit(1)).alias("held")), "node")
    total = prints.count()
    linked = with_group(prints.select("doc_id", "hash", "node"), held, "node", "held", total)
    alone = prints.join(roots.select("node"), "node", "left_anti").select("doc_id", "hash", F.col("node").alias("component"))
    return materialise(linked.select("doc_id", "hash", "component").union(alone), "named")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (its least id) for every row of docs (doc_id, text)."""
    ids = _named(docs)
    least = materialise(ids.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("held")), "least")
    return with_group(ids, least, "component", "held", ids.count()).select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of the least id (null last), then of the least hash of its text.

    Decisions are by row: rows that share an id go or stay by their own texts, and of equal rows one stays.
    """
    ids = _named(docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    first = ids.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1")
    several = with_group(ids, materialise(first, "first_rows"), "component", "held", ids.count())
    # rows of a component other than its first; a place is taken by its text's hash and id
    gone = several.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))))
    gone = materialise(gone.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct(), "dropped")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    left = docs.join(small(gone, gone.count(), BROADCAST_KEYS), same, "left_anti")
    repeated = ids.groupBy("doc_id", "hash").count().where("count > 1")
    if repeated.isEmpty():
        return left
    own = left.select(F.struct(*[left[c] for c in left.columns]).alias("row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"))
    return own.dropDuplicates(["__id", "__hash"]).select("row.*")
