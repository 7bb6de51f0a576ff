"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups go, largest first, to the least-loaded shard of a heap.
Groups of one size are interchangeable for that rule, so the heap runs over (size, number of groups) pairs: the distinct
sizes of groups whose bytes add up to T are at most sqrt(2 T) many, which bounds the driver's share (14 million sizes at
100 TB, held and sent as arrays of numbers: some 24 bytes each, and as many for each run). Which group of a size goes where follows from its rank among them; ranks and slots are numbered by buckets,
so neither a hot size nor a shard is gathered in one task. A text that a third of all rows repeat is one group and must
lie in one shard; sizes are as near equal as groups allow (LPT is within 4/3 of the best largest shard).

Null text counts as empty (size 1, as for empty texts, which it joins). Repeated rows each take a slot. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_utf8, dense_rank, materialise, shuffle_partitions, with_group

SHARDS = 16
#: Groups of one size that are numbered in one bucket.
RANKED = 1 << 16


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, to, ends): size i's groups, by rank, fill runs offsets[i] to offsets[i + 1]: shard `to` up to rank `ends`.

    Sizes come largest first; the runs are as the LPT heap deals them.
    """
    loads = [0] * shards
    heap = [(0, s) for s in range(shards)]
    offsets, to, ends = array("q", [0]), array("i"), array("q")
    for size, count in zip(sizes.tolist(), counts.tolist(), strict=True):
        got = [0] * shards
        if count > 4 * shards:
            # the heap takes the `count` smallest of load + j * size: all below the highest level that stays within it
            low, high = min(loads), max(loads) + size * count
            while low < high:
                level = (low + high + 1) // 2
                if sum(-(-(level - x) // size) for x in loads if x < level) <= count:
                    low = level
                else:
                    high = level - 1
            got = [-(-(low - x) // size) if x < low else 0 for x in loads]
            loads = [x + g * size for x, g in zip(loads, got, strict=True)]
            count -= sum(got)
            heap = sorted((x, s) for s, x in enumerate(loads))
        for _ in range(count):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            loads[s] = load + size
            got[s] += 1
        end = 0
        for s, g in enumerate(got):
            if g:
                end += g
                to.append(s)
                ends.append(end)
        offsets.append(len(to))
    return np.array(offsets, np.int64), np.array(to, np.int32), np.array(ends, np.int64)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), crc32_utf8(text).alias("text_crc32"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("key"))
    rows = materialise(rows, "rows")
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("group_bytes"), F.count(F.lit(1)).alias("held")), "groups")
    found = groups.groupBy("group_bytes").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("group_bytes", "descending")])
    sizes, counts = (found.column(c).to_numpy() for c in ("group_bytes", "n"))
    offsets, to, ends = schedule(sizes, counts, shards)
    lists = [pa.LargeListArray.from_arrays(offsets, values) for values in (to, ends)]
    dealt = pa.table({"group_bytes": pa.array(sizes, pa.int64()), "to": lists[0], "ends": lists[1], "buckets": pa.array(np.maximum(1, -(-counts // RANKED)), pa.int64())})
    dealt = materialise(spark.createDataFrame(dealt), "dealt") if len(sizes) else spark.createDataFrame([], "group_bytes long, to array<int>, ends array<long>, buckets long")
    ranked = dense_rank(groups.join(dealt, "group_bytes"), ["group_bytes"], ["key"], "rank", F.col("buckets"))
    place = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    named = materialise(ranked.select("key", "held", F.get("to", place).cast("int").alias("shard")), "named")
    placed = with_group(rows, named, "key", "held", rows.count())
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard"), "placed")
    numbered = dense_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", 4 * shuffle_partitions(spark))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
