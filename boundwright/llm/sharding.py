"""Minimax contiguous sharding.

Equal texts form an atomic group; groups stand in the order of their least doc_id. The groups are cut
into contiguous runs, one a shard, so that the largest shard is as small as it can be: the smallest
feasible capacity is found by binary search, each capacity checked greedily (fill a shard as far as it
holds, then open the next).

The order is made by a range partition, which splits even one huge group, and running sums over it; the
driver never sees the groups. It sees where running sums end, in at most BUCKETS buckets of equal width:
the least and the greatest end in each. They bound every greedy step from both sides, so the search ends
with a bracket of capacities, and only the buckets that the cuts in that bracket can touch are looked
into, again BUCKETS at a time, until the bracket is one capacity and its cuts are exact.

Defined results: a null text has no bytes, size 1, and is equal to the empty text; rows with a null
doc_id come last in their group's order; repeated rows each get a slot. With fewer groups than shards the
last shards are empty; an empty table gives an empty one. A group greater than an even share makes its shard that
large. Texts of any length count by their bytes and move as digests. Columns other than doc_id and text are not read. Rows that
are equal in text and in doc_id, or have none, have one place in the order and are dealt to one task, a few dozen bytes each.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundwright.llm.common import bounded_batches, checkpointed, table, written

SHARDS = 8
BUCKETS = 1 << 14
LAST = (1 << 63) - 1


class Ends:
    """What is known of the groups' ends: sorted (least, greatest, several) of each bucket that has any; several: it has ends between."""

    def __init__(self, buckets: list[tuple[int, int, bool]]):
        self.buckets = sorted(buckets)
        self.least = [b[0] for b in self.buckets]

    def reach(self, upto: int) -> tuple[int, int]:
        """Bounds of the greatest end that is at most `upto`."""
        k = bisect_right(self.least, upto) - 1
        if k < 0:
            return 0, 0
        low, high, several = self.buckets[k]
        if high <= upto:
            return high, high
        return low, (upto if several else low)

    def cuts(self, capacity: int, shards: int, side: int) -> list[int]:
        """The ends of the shards that the greedy check fills, by the lower (0) or upper (1) bound of each step."""
        out, at = [], 0
        for _ in range(shards):
            at = max(at, self.reach(at + capacity)[side])
            out.append(at)
        return out

    def smallest(self, low: int, high: int, total: int, shards: int, side: int) -> int:
        """The smallest capacity in [low, high] that is feasible by the given bounds; high is known to be."""
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, side)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low


def minimax(groups: DataFrame, shards: int, buckets: int = BUCKETS) -> list[int]:
    """The ends of the shards of the smallest feasible capacity. groups: (end, size), end: the running sum with the group's own size."""
    total, largest = groups.agg(F.max("end"), F.max("size")).first()
    if total is None:
        return [0] * shards
    low, high = max(largest, -(-total // shards)), total

    def look(windows: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
        """The buckets of the ends in the windows (first, last), which do not overlap."""
        width = max(1, -(-sum(b - a + 1 for a, b in windows) // buckets))
        first = F.array(*[F.lit(a) for a, _ in windows])
        inside = groups.filter(" OR ".join(f"end BETWEEN {a} AND {b}" for a, b in windows))
        window = F.size(F.filter(first, lambda x: x <= F.col("end")))
        place = ((F.col("end") - F.element_at(first, window)) / width).cast("long")
        rows = inside.groupBy(window.alias("w"), F.floor(place).alias("k")).agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count("*").alias("n")).collect()
        return [(r.a, r.b, r.n > 2) for r in rows]

    known = Ends(look([(1, total)]))
    while True:
        high = known.smallest(low, high, total, shards, 0)
        low = known.smallest(low, high, total, shards, 1)
        if low == high and (cuts := known.cuts(low, shards, 0)) == known.cuts(low, shards, 1):
            return cuts
        # Each greedy step lands between its lower bound at the least capacity and its upper bound at the greatest.
        spans = zip(known.cuts(low, shards, 0), known.cuts(high, shards, 1), strict=True)
        windows: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            touched = [x for x in known.buckets[max(0, bisect_right(known.least, a) - 1) : bisect_right(known.least, b)] if x[2]]
            for x in touched:
                if windows and x[0] <= windows[-1][1] + 1:
                    windows[-1] = (windows[-1][0], max(windows[-1][1], x[1]))
                else:
                    windows.append((x[0], x[1]))
        windows = joined(windows, 64)
        outside = [x for x in known.buckets if not any(a <= x[0] <= b for a, b in windows)]
        known = Ends(outside + look(windows))


def joined(windows: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The windows with the least gaps closed, until there are at most `most`."""
    while len(windows) > most:
        k = min(range(len(windows) - 1), key=lambda i: windows[i + 1][0] - windows[i][1])
        windows[k : k + 2] = [(windows[k][0], windows[k + 1][1])]
    return windows


def in_order(rows: DataFrame) -> DataFrame:
    """rows (doc_id, size, text_crc32, content) with `upto` and `place`: the running sum of sizes and the running count in the order of groups."""
    spark = rows.sparkSession
    id_ = F.coalesce("doc_id", F.lit(LAST))
    heads = written(rows.groupBy("content").agg(F.min(id_).alias("head")), "heads")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["head", "content", F.coalesce("doc_id", F.lit(LAST))]
    dealt = rows.join(heads, "content").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # A checkpoint keeps its partitions, so the sums below and the running sums see the same ones.
    dealt = checkpointed(dealt.withColumn("part", F.spark_partition_id()))
    # One total a partition: as many rows as partitions.
    sums = {r.part: (r.s, r.n) for r in dealt.groupBy("part").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    base, upto, place = {}, 0, 0
    for part in sorted(sums):
        base[part] = (upto, place)
        upto, place = upto + sums[part][0], place + sums[part][1]

    def running(batches):
        size = None
        for some in batches:
            if len(some):
                if size is None:
                    size, count = base[int(some["part"].iloc[0])]
                some = some.assign(upto=size + some["size"].cumsum(), place=count + pd.RangeIndex(1, len(some) + 1).to_numpy())
                size, count = int(some["upto"].iloc[-1]), int(some["place"].iloc[-1])
                yield some[names]

    schema = "doc_id long, size long, text_crc32 long, content binary, upto long, place long"
    names = [x.split()[0] for x in schema.split(", ")]
    return dealt.select("part", *names[:4]).mapInPandas(running, schema)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document, in shards of equal bytes as nearly as whole groups allow."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("content")
    )
    ordered = written(in_order(rows), "ordered")
    groups = written(ordered.groupBy("content").agg(F.max("upto").alias("end"), F.sum("size").alias("size")), "groups")
    cuts = minimax(groups, shards)
    shard = sum(((F.col("upto") > c).cast("int") for c in cuts[:-1]), F.lit(0))
    placed = ordered.withColumn("shard", shard)
    # One count a shard.
    first = {r.shard: r.place for r in placed.groupBy("shard").agg(F.min("place").alias("place")).collect()}
    starts = F.array(*[F.lit(first.get(k, 1)).cast("long") for k in range(shards)])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - starts[F.col("shard")]).alias("slot"))


def op5_minimax_shards(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot; the law is `bytes`."""
    return sharded(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_minimax_shards": op5_minimax_shards}
