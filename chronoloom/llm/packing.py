"""Filling containers of fixed capacity with items of varying length (problem 8)."""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.token_ids import VOCABULARY, token_counts
from chronoloom.spark_tools import written

#: Parts into which the items of one length are dealt for ranking, so that a length that a third of all items have is many tasks.
RANK_PARTS = 512


def packing_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern, by shortest-pack-first over the length histogram.

    Lengths are placed longest first; all items of a length go at once into the packs with the most room left, as many as there are of
    them, which turns their pattern into a longer one; what fits nowhere opens new packs. Work is by patterns, not by items.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    heap: list[int] = []
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n > 0:
            while heap and not room[-heap[0]]:
                heapq.heappop(heap)
            space = -heap[0] if heap else -1
            if space < length:
                count, pattern, space, take = n, (), capacity, n
            else:
                count, pattern = room[space].pop()
                take = min(count, n)
                if count > take:
                    room[space].append((count - take, pattern))
            room[space - length].append((take, (*pattern, length)))
            heapq.heappush(heap, length - space)
            n -= take
    return sorted((c, p) for packs in room.values() for c, p in packs if c)


def packed(items: DataFrame, capacity: int) -> DataFrame:
    """Adds container_id and splits: one row per piece with key, piece_no, from_token, n_tokens, container_id.

    `items` has `key` and `n_tokens`; null, zero and negative sizes take no part. An item larger than `capacity` is cut into full containers
    and a rest, which is packed like any other; all other items stay whole. Containers are numbered from 0 without holes.
    Method: shortest-pack-first over the histogram of lengths (at most `capacity` numbers reach the driver, whatever the rows), then patterns
    are joined back to items by their rank within their length. Ranks are counted by parts, so no task holds all items of a length.
    Ties of equal keys are settled by the order of a part; repeated rows are items of their own; an empty table gives no containers.
    """
    spark = items.sparkSession
    n = F.col("n_tokens")
    full = F.floor((n - 1) / capacity)
    pieces = F.transform(F.sequence(F.lit(0), full), lambda i: F.struct(i.alias("piece_no"), (i * capacity).alias("from_token"), F.least(F.lit(capacity), n - i * capacity).cast("int").alias("_len")))
    rows = items.where("n_tokens > 0").select("key", F.explode(pieces).alias("p")).select("key", "p.*").withColumn("_part", F.pmod(F.xxhash64("key", "piece_no"), F.lit(RANK_PARTS)))
    counts = written(rows.groupBy("_len", "_part").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    before = Window.partitionBy("_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_len", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    histogram = {r[0]: r[1] for r in counts.groupBy("_len").agg(F.sum("_n")).collect()}
    slots, first = [], 0
    used: dict[int, int] = defaultdict(int)
    for count, pattern in packing_patterns(histogram, capacity):
        for length in sorted(set(pattern)):
            times = pattern.count(length)
            slots.append((length, used[length], used[length] + count * times, first, times))
            used[length] += count * times
        first += count
    # Every length's ranks are cut into consecutive ranges, one per pattern: an array per length, at most `capacity` rows.
    by_length: dict[int, list] = defaultdict(list)
    for length, lo, hi, base, times in slots:
        by_length[length].append((lo, hi, base, times))
    table = spark.createDataFrame(sorted(by_length.items()), "_len int, _slots array<struct<lo:bigint,hi:bigint,base:bigint,times:int>>")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_len", "_part").orderBy("key", "piece_no")) - 1)
    # The window left the rows dealt by length and part, so this join moves only the offsets.
    ranked = ranked.join(offsets.hint("merge"), ["_len", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_offset"))
    ranked = ranked.join(F.broadcast(table), "_len")
    slot = F.element_at(F.filter("_slots", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"])), 1)
    out = ranked.withColumn("_slot", slot)
    at = F.col("_slot.base") + F.floor((F.col("_rank") - F.col("_slot.lo")) / F.col("_slot.times"))
    return out.select("key", F.col("piece_no").cast("int").alias("piece_no"), F.col("from_token").cast("bigint").alias("from_token"), F.col("_len").cast("bigint").alias("n_tokens"), at.cast("bigint").alias("container_id"))


def document_containers(documents: DataFrame, capacity: int = 1024, path: str = VOCABULARY) -> DataFrame:
    """doc_id, piece_no, from_token, n_tokens, container_id of the documents' whole texts, measured in tokens."""
    sizes = written(token_counts(documents, "doc_id", "text", path), "sizes")
    return packed(sizes.withColumnRenamed("doc_id", "key"), capacity).withColumnRenamed("key", "doc_id")
