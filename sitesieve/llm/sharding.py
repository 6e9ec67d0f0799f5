"""Shards of near-equal bytes for indivisible groups of equal texts, by Karmarkar-Karp differencing.

Differencing is sequential, so it runs over a bounded number of items, whatever the size of the corpus:

* a group of equal texts that holds at least 1/``BUNDLES`` of a shard's bytes is an item by itself;
* all smaller groups are dealt by hash into ``BUNDLES`` bundles per shard, and each bundle is an item.

At most ``2 * BUNDLES * shards`` items result. On a small corpus a bundle holds a group or none, on a large one many groups,
and the differencing evens out what the hash leaves uneven. Equal texts always share a shard; one group larger than a
shard's fair part stays whole, since groups are indivisible.

Nulls: a null text counts as an empty one (8 bytes, checksum 0); rows with a null ``doc_id`` are placed like others. Repeated
rows are rows of their own with slots of their own; equal ones are counted first and numbered from the count, so many of them
span many tasks. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import settle, stored
from .keys import text_key, unrolled

SHARDS = 24
#: Bundles per shard. The spread that is left is far below the size of one bundle.
BUNDLES = 256
#: Rows that are numbered by one sort.
UNIT_ROWS = 100_000
#: Equal rows that one task numbers.
COPIES = 10_000
#: Bytes that a document takes besides its text.
OVERHEAD = 8


def difference(sizes: list[int], shards: int) -> list[int]:
    """Shard of each item. The two partial partitions of the largest spread are combined, one of them in opposite order,
    until one is left.
    """
    if not sizes:
        return []
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [size] + [0] * (shards - 1), [[i]] + [[] for _ in range(shards - 1)]))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, sums, members = heapq.heappop(heap)
        _, _, other_sums, other_members = heapq.heappop(heap)
        both = []
        for a, b, left, right in zip(sums, reversed(other_sums), members, reversed(other_members), strict=True):
            left, right = (left, right) if len(left) >= len(right) else (right, left)
            left.extend(right)
            both.append((a + b, left))
        both.sort(key=lambda x: -x[0])
        # Only differences matter, so the common part is taken off and numbers stay small.
        least = both[-1][0]
        heapq.heappush(heap, (least - both[0][0], made, [s - least for s, _ in both], [m for _, m in both]))
        made += 1
    shard = [0] * len(sizes)
    for k, members in enumerate(heap[0][3]):
        for i in members:
            shard[i] = k
    return shard


def _placed(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = pd.concat(list(batches) or [pd.DataFrame({"k1": [], "k2": [], "bundle": [], "bytes": []})])
        items = items.sort_values(["bytes", "bundle", "k1", "k2"], ascending=[False, True, True, True], kind="stable")
        items["shard"] = difference([int(x) for x in items["bytes"]], shards)
        items["item"] = range(len(items))
        yield items

    return run


def shards_by_bytes(documents: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of every document."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            *text_key(),
        )
        .groupBy("doc_id", "size", "text_crc32", "k1", "k2")
        .agg(F.count("*").alias("_n")),
        "sizes",
    )
    bytes_ = F.sum(F.col("size") * F.col("_n"))
    groups = rows.groupBy("k1", "k2").agg(bytes_.alias("bytes"), F.sum("_n").alias("n"))
    total = rows.agg(bytes_).first()[0] or 0
    number = shards * bundles
    heavy = F.col("bytes") * number >= total
    # At most 2 * number rows: a group is heavy only with 1/number of all bytes, and the others have number bundles.
    items = (
        groups.withColumn("bundle", F.when(~heavy, F.pmod("k1", F.lit(number))).otherwise(-1).cast("long"))
        .groupBy(
            F.when(heavy, F.col("k1")).otherwise(0).alias("k1"),
            F.when(heavy, F.col("k2")).otherwise(0).alias("k2"),
            "bundle",
        )
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    )
    shape = "k1 long, k2 long, bundle long, bytes long, n long, shard int, item long"
    items = settle(items.repartition(1).mapInPandas(_placed(shards), shape))
    # Both sides of the look-up have at most ``number`` rows.
    light = F.broadcast(items.filter("bundle >= 0").select("bundle", F.struct("item", "shard", "n").alias("_light")))
    large = F.broadcast(items.filter("bundle < 0").select("k1", "k2", F.struct("item", "shard", "n").alias("_large")))
    placed = (
        unrolled(rows, COPIES)
        .withColumn("bundle", F.pmod("k1", F.lit(number)))
        .join(large, ["k1", "k2"], "left")
        .join(light, "bundle", "left")
        .withColumn("_at", F.coalesce("_large", "_light"))
        .select("doc_id", "size", "text_crc32", "k1", "k2", "_nth", "_at.item", "_at.shard", F.col("_at.n").alias("_rows"))
        # A large item is numbered in several units, or one sort would take all its rows.
        .withColumn("unit", F.pmod(F.xxhash64("doc_id", "k1", "_nth"), F.ceil(F.col("_rows") / UNIT_ROWS)))
        .drop("_rows")
    )
    before = W.partitionBy("shard").orderBy("item", "unit").rowsBetween(W.unboundedPreceding, -1)
    units = placed.groupBy("shard", "item", "unit").agg(F.count("*").alias("_n"))
    units = units.select("item", "unit", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("item", "unit").orderBy("doc_id", "k1", "k2", "_nth")
    return (
        placed.withColumn("_place", F.row_number().over(inside))
        .join(units, ["item", "unit"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_place") - 1).alias("slot"))
    )
