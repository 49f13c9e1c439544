"""Longest-processing-time sharding: groups that must stay together are dealt from the largest to the
smallest, each to the shard with the least load."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import ranks_in_parts, small_side, whole
from draftlake.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """``row_bytes`` is added to the UTF-8 bytes of every row. Groups whose sizes agree in their first
    ``bits`` binary digits are one class for the heap, so sizes below 2**bits are exact and larger
    ones differ by less than 1 / 2**(bits - 1) from their class; the driver holds at most
    2**(bits - 1) classes per power of two, whatever the number of groups. ``part_rows``: rows
    numbered together in one piece of a class or shard."""

    shards: int = 40
    row_bytes: int = 16
    bits: int = 12
    part_rows: int = 2_000


def longest_first(classes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """For every (size, count), given from the largest size down: (shard, groups) as the heap deals them.

    The heap gives each group to the shard of least (load, number). Many groups of one size take the
    ``count`` smallest of the loads load + k * size of all shards, so all but the last few are dealt at
    once below a level found by bisection: the same result as group by group."""
    heap = [(0, i) for i in range(shards)]
    out = []
    for size, count in classes:
        got = [0] * shards
        if count > shards:
            low, high = 0, max(load for load, _ in heap) + size * count + 1
            below = lambda level: sum(max(0, -((load - level) // size)) for load, _ in heap)
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if below(mid) <= count else (low, mid)
            for load, i in heap:
                got[i] = max(0, -((load - low) // size))
            heap = [(load + got[i] * size, i) for load, i in heap]
            heapq.heapify(heap)
        for _ in range(count - sum(got)):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            got[i] += 1
        out.append([(i, n) for i, n in enumerate(got) if n])
    return out


def leading_digits(size: Column, bits: int) -> Column:
    """The number with all but its first ``bits`` binary digits set to zero."""
    rest = F.greatest(F.length(F.bin(size)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, rest), rest)


def group_shards(groups: DataFrame, key: list[str], s: Settings) -> DataFrame:
    """``groups`` (key columns, bytes) with their shard. The driver receives one row per class of
    sizes and returns runs of ranks per class, at most one per shard."""
    classed = groups.withColumn("__class", leading_digits(F.col("bytes"), s.bits))
    found = classed.groupBy("__class").agg(F.count("*").alias("n"), F.sum(F.col("bytes").cast("decimal(38,0)")).alias("total")).collect()
    sizes = sorted(((max(1, round(int(r.total) / r.n)), r.n, r["__class"]) for r in found), reverse=True)
    plan = []
    for (_, count, name), dealt in zip(sizes, longest_first([x[:2] for x in sizes], s.shards), strict=True):
        runs, until = [], 0
        for shard, n in dealt:
            until += n
            runs.append((until, shard))
        plan.append((name, -(-count // s.part_rows), runs))
    table = groups.sparkSession.createDataFrame(plan, "__c bigint, __parts bigint, __runs array<struct<until:bigint,shard:int>>")
    known = classed.join(small_side(table), F.col("__class") == F.col("__c")).drop("__c")
    placed = ranks_in_parts(known, "__class", F.col("__parts"), key, "__rank")
    run = F.get(F.filter("__runs", lambda r: r["until"] > F.col("__rank")), F.lit(0))
    return placed.select(*groups.columns, run["shard"].alias("shard"))


def shard_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of ``docs``.

    Rows of equal text are one group and stay together; null text is empty. Groups are told apart by
    two 64-bit hashes and the length: two texts that agree in all would merely share a shard. Slots
    number the rows of a shard from 0 without a gap, in the order of a hash of the row; rows that
    repeat take slots of their own. Null ids are allowed, other columns take no part, an empty table
    gives an empty table.

    Texts are read once, and only ids, sizes and hashes move. Sizes of groups are combined before the
    shuffle; rows of groups of over ``part_rows`` rows (at most one such group per ``part_rows`` rows)
    meet their shard in a join that is broadcast up to a checked size."""
    s = settings or Settings()
    content = whole(text)
    rows = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(content) + F.lit(s.row_bytes)).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"), F.xxhash64(content).alias("__g"), F.xxhash64(F.lit(1), content).alias("__h"),
    ))
    key = ["__g", "__h", "size"]
    groups = cut_lineage(rows.groupBy(*key).agg(F.count("*").alias("__rows"), F.sum("size").alias("bytes")))
    placed = cut_lineage(group_shards(groups, key, s))
    named = placed.select(*[F.col(k).alias(f"{k}_") for k in key], "shard", "__rows")
    same = [F.col(k) == F.col(f"{k}_") for k in key]
    gone = [f"{k}_" for k in key]
    hot = small_side(named.where(F.col("__rows") > s.part_rows).drop("__rows"))
    met = rows.join(hot, same, "left").drop(*gone)
    rest = named.where(F.col("__rows") <= s.part_rows).drop("__rows")
    late = met.where("shard is null").drop("shard").join(rest, same).drop(*gone)
    dealt = cut_lineage(met.where("shard is not null").unionByName(late))
    counts = {r.shard: r["count"] for r in dealt.groupBy("shard").count().collect()}
    parts = F.lit([-(-counts.get(i, 0) // s.part_rows) or 1 for i in range(s.shards)])
    split = dealt.withColumn("__parts", F.get(parts, F.col("shard")))
    numbered = ranks_in_parts(split, "shard", F.col("__parts"), ["doc_id", "__g", "__h"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"))
