"""Sharding by Karmarkar-Karp differencing.

Law ``bytes``: groups of equal texts are indivisible and the shards' bytes are
as near equal as differencing gets them.  Karmarkar-Karp starts from one partial
partition for each item (the item in one shard, the others empty) and repeatedly
combines the two of largest spread, the largest shard of one with the smallest of the
other, until one is left.

How it scales: every group is an item.  While there are more than ``most`` items, they are dealt to tasks of at
most about ``most`` each, differenced there into ``POOLS`` pools of nearly equal bytes, and the pools
are the items of the next level; items of more than ``1 / most`` of all bytes (there are fewer than ``most`` of
them) are not pooled.  The last level's items, ``most`` at most and about, are differenced
into the shards.  Slots are numbered in two levels, by
``sqrt(n)`` hash buckets of a shard and inside each.

Rules for odd input: a null text has size 1 and the checksum of the empty text, and
goes with the empty texts; repeated rows are rows of their own, with slots of
their own (they are counted before they are dealt, so they gather nowhere); null ids are rows like others; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, with_id

POOLS = 16


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item; ties by item order."""
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(0, []) for _ in range(shards - 1)] + [(size, [i])]))
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = []
        for (x, own), (y, other) in zip(a, reversed(b), strict=True):
            if len(own) < len(other):
                own, other = other, own
            own.extend(other)
            both.append((x + y, own))
        both.sort(key=lambda p: p[0])
        heapq.heappush(heap, (both[0][0] - both[-1][0], number, both))
        number += 1
    out = [0] * len(sizes)
    for shard, (_, own) in enumerate(reversed(heap[0][2])) if heap else ():
        for i in own:
            out[i] = shard
    return out


def _pooled(items: DataFrame, level: int, most: int, total: int) -> DataFrame:
    """``item, up``: the pool of each item, or the item itself with a number of its own if it is too large to be pooled."""
    parts = -(-items.count() // most)
    large = F.col("bytes") * most > total
    dealt = items.where(~large).withColumn("part", F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(parts)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bytes", "descending"), ("item", "ascending")])
        own = difference(t["bytes"].to_pylist(), POOLS)
        return pa.table({"item": t["item"], "up": pa.array([t["part"][0].as_py() * POOLS + k for k in own], pa.int64())})

    # pools have numbers from 0, items of their own negative ones
    alone = items.where(large).select("item", (-1 - F.row_number().over(W.orderBy("item"))).cast("long").alias("up"))
    return dealt.groupBy("part").applyInArrow(run, "item long, up long").unionByName(alone)


def shards_of(groups: DataFrame, shards: int, most: int) -> DataFrame:
    """``item, shard`` of ``groups`` (``item, bytes``, an item once)."""
    total, level, levels, items = groups.agg(F.sum("bytes")).first()[0] or 0, 0, [], groups
    while items.count() > 2 * most + POOLS:
        levels.append(keep(_pooled(items, level, most, total)))
        items = keep(levels[-1].join(items, "item").groupBy(F.col("up").alias("item")).agg(F.sum("bytes").alias("bytes")))
        level += 1
    last = items.orderBy(F.desc("bytes"), "item").collect()
    placed = zip((r.item for r in last), difference([r.bytes for r in last], shards), strict=True)
    out = groups.sparkSession.createDataFrame([(int(i), int(k)) for i, k in placed], "item long, shard int")
    for pooled in reversed(levels):
        out = pooled.join(out.withColumnRenamed("item", "up"), "up").select("item", "shard")
    return out


def shard(docs: DataFrame, doc_id: str | Column = "doc_id", text: str | Column = "text", shards: int = 8, most: int = 20_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    rows = keep(with_id(docs, doc_id, (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("item")))
    # texts that share a hash go to the same shard; that keeps equal texts together all the same
    groups = keep(rows.groupBy("item").agg(F.sum("size").alias("bytes")))
    alike = rows.groupBy("doc_id", "size", "text_crc32", "item").agg(F.count(F.lit(1)).alias("n"))
    placed = keep(alike.join(shards_of(groups, shards, most), "item").drop("item"))
    return _slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slots(rows: DataFrame) -> DataFrame:
    """Each row of ``rows`` as often as its ``n`` says, with its ``slot``: gapless from 0 in each shard."""
    buckets = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    upto = F.sum("n").over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    ended = rows.withColumn("upto", upto).join(offsets, ["shard", "bucket"])
    first = F.col("offset") + F.col("upto") - F.col("n")
    return ended.withColumn("slot", F.explode(F.sequence(first, first + F.col("n") - 1)))
