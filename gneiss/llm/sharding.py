"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` arcs of the 64-bit ring. A row falls on the arc that its hash meets clockwise. A shard
takes no more than its capacity; rows that overflow a full shard go on clockwise to the next shard that has room.
Capacities are the row count divided by the shards, the first (count mod shards) of them one larger, so the law
`rows` holds: shard sizes differ by one at most, however the hashes fall.

Rows of one arc are interchangeable but for their order, so overflow is settled on arc counts (a table of shards x
vnodes entries, whatever the input): round r lets what is left of each arc try the r-th shard ahead. The outcome is,
for each arc, a list of intervals of ranks with a shard and a first slot. Rows of an arc are ranked by a second hash, which
does not depend on the arc, in windows over small buckets of it and sums of bucket counts. No task sees a whole shard, arc or key.

Defined cases: null or empty text has no bytes (size 8, crc32 0). Equal rows are counted and spread like others; very long texts
are read once. Null ids hash as a value of their own. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import running, unrolled

VNODES, BITS = 64, 16


def ring(shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """Positions (the ring's first BITS bits) in order, and the shard of each."""
    points = sorted((xxhash.xxh3_64_intdigest(f"shard-{s}-{v}") >> (64 - BITS), s) for s in range(shards) for v in range(vnodes))
    return [p for p, _ in points], [s for _, s in points]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def settle(counts: list[int], owner: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for all ranks of all arcs; arcs and their owners in ring order."""
    free, left, taken, out, n = list(capacity), list(counts), [0] * len(counts), [], len(counts)
    slots = [0] * len(capacity)
    waiting = [a for a in range(n) if left[a]]
    for step in range(n):
        for a in waiting:
            s = owner[(a + step) % n]
            k = min(left[a], free[s])
            if k:
                out.append((a, taken[a], taken[a] + k, s, slots[s]))
                left[a] -= k
                taken[a] += k
                free[s] -= k
                slots[s] += k
        waiting = [a for a in waiting if left[a]]
        if not waiting:
            break
    return out


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES) -> DataFrame:
    """One row per row of docs: the id, size, text_crc32, shard (int) and slot (long, gapless from 0 in each shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("crc"))
    place = F.xxhash64("id", "crc", "size")
    points, owner = ring(shards, vnodes)
    # the first point at or after a position; past the last one, the first
    arcs = [(p, bisect.bisect_left(points, p) % len(points)) for p in range(1 << BITS)]
    arcs = spark.createDataFrame(arcs, "at long, arc int")
    kept = rows.withColumn("place", place).groupBy("id", "size", "crc", "place").agg(F.count("*").alias("copies"))
    kept = kept.withColumn("at", F.shiftrightunsigned("place", 64 - BITS)).join(F.broadcast(arcs), "at").drop("at")
    # places of one arc lie close together: the order within it comes from another hash
    kept = kept.withColumn("place", F.xxhash64(F.lit("rank"), "place"))
    counted = {r[0]: r[1:] for r in kept.groupBy("arc").agg(F.sum("copies"), F.max("copies"), F.count("*")).collect()}
    counts = [counted[a][0] if a in counted else 0 for a in range(len(points))]
    plan = settle(counts, owner, capacities(sum(counts), shards))
    pieces = spark.createDataFrame(plan or [(0, 0, 0, 0, 0)], "arc int, lo long, hi long, shard int, slot0 long")
    # equal rows have equal places: they form one interval of ranks, cut at the ends of the pieces
    sizes = spark.createDataFrame([(a, r[2]) for a, r in counted.items()] or [(0, 0)], "arc int, group_rows long")
    ranked = running(kept.join(F.broadcast(sizes), "arc"), ["arc"], ["id", "crc", "size"], "copies")
    cut = ranked.join(F.broadcast(pieces), "arc").where("before < hi and before + copies > lo")
    cut = cut.withColumn("first", F.greatest("before", "lo")).withColumn("last", F.least(F.expr("before + copies"), "hi") - 1)
    out = unrolled(cut, "first", "last", "r", max((r[1] for r in counted.values()), default=0))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("slot0") + F.col("r") - F.col("lo")).alias("slot"))
