"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) are sorted by size; each goes to the shard that has least so far, through a
heap. Where a group goes depends only on how many groups there are of each size, so the plan is made from that histogram:
its sizes differ, so there are at most sqrt(2 * all bytes) of them, however many groups there are. Groups then take their
places by their rank within their size, and rows their slots by their rank within their shard; both ranks
come from one range-partitioned sort.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .quantised import meet

SHARDS = 16


def spread(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` items of one size each shard gets if each item goes to the least loaded (ties: the smaller one).

    Items start at load, load + size, ... of a shard, lowest starts first: all starts below a level are taken, and the first
    shards that would start at it.
    """
    taken = lambda level: [max(0, -((x - level) // size)) for x in loads]
    low, high = min(loads), max(loads) + size * count
    while low < high:  # the highest level below which at most `count` items start
        level = (low + high + 1) // 2
        low, high = (level, high) if sum(taken(level)) <= count else (low, level - 1)
    got = taken(low)
    rest = count - sum(got)
    for s, x in enumerate(loads):
        if rest and x + got[s] * size == low:
            got[s] += 1
            rest -= 1
    return got


def longest_first(sizes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For each (size, groups of it), largest first: how many of those groups each shard gets."""
    heap, out = [(0, s) for s in range(shards)], []
    for size, count in sorted(sizes, reverse=True):
        got = [0] * shards
        if count <= 4 * shards:
            for _ in range(count):
                load, s = heap[0]
                got[s] += 1
                heapq.heapreplace(heap, (load + size, s))
        else:
            loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
            got = spread(loads, size, count)
            heap = [(load + size * n, s) for s, (load, n) in enumerate(zip(loads, got, strict=True))]
            heapq.heapify(heap)
        out.append((size, got))
    return out


def ranked(rows: DataFrame, by: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """rows in one sort of all of them, where `order` starts with `by`; and for each part and value of `by` where it starts.

    Sorted rows are numbered by part and place; (part, by, first, before, n) has at most a row for each part and one for
    each value. A row's rank within its value is its number less first, plus before.
    """
    sorted_ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33).alias("__part")
    sorted_ = sorted_.select("*", part)
    starts = sorted_.groupBy("__part", by).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    return sorted_, starts.select("__part", by, "__first", "__n", F.coalesce(before, F.lit(0)).alias("__before"))


def assigned(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """rows (key, size, ...) with their shard: rows of one key stay together, shards are near equal in size."""
    spark = rows.sparkSession
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups, starts = ranked(groups, "bytes", [F.desc("bytes"), F.asc("key")])
    starts = stored(starts, "starts")
    sizes = [(r.bytes, r.n) for r in starts.groupBy("bytes").agg(F.sum("__n").alias("n")).collect()]
    placed = longest_first(sizes, shards)
    plan = spark.createDataFrame(
        pa.table({"bytes": pa.array([s for s, _ in placed], pa.int64()), "got": pa.array([g for _, g in placed], pa.list_(pa.int64()))})
    )
    ends = plan.select("bytes", F.transform("got", lambda _, i: F.aggregate(F.slice("got", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x)).alias("ends"))
    rank = F.col("__at") - F.col("__first") + F.col("__before")
    at = F.size(F.filter("ends", lambda end: end <= F.col("rank"))).alias("shard")
    groups = groups.join(starts.join(ends, "bytes"), ["__part", "bytes"]).select("key", "n", "ends", rank.alias("rank")).select("key", "n", at)
    return meet(rows, stored(groups, "groups"), "key", total)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, law, shard, slot, grown_shard of every row, by the law `bytes`: shards of near equal sizes.

    A size is the text's bytes and one more. Rows with equal texts share a shard, null texts with empty ones; a group that is
    larger than an even share has its shard to itself, as far as that goes. Slots follow ids within a shard, null ids last;
    repeated rows each have their own. Whole texts count, however long: only their digests move. Other columns are ignored;
    an empty table gives no rows. grown_shard, which another law has, is null.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "rows")
    out = assigned(rows, shards, rows.count()).drop("key", "n")
    out, starts = ranked(out, "shard", [F.asc("shard"), F.asc_nulls_last("id"), F.asc("row")])
    # one row for each part and at most one more for each shard
    out = out.join(F.broadcast(starts.drop("__n")), ["__part", "shard"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("__at") - F.col("__first") + F.col("__before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
