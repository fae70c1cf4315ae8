"""Call-graph operators over edge tables. Each round ends in a written table; only counts come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundwright.sources.shared import written


def kept(df: DataFrame) -> DataFrame:
    return written(df, "graph")


def edges(calls: DataFrame) -> DataFrame:
    """One row for each caller and callee: calls, distinct call sites, first line."""
    named = calls.filter("caller <> '' AND callee <> ''")
    return named.groupBy("caller", "callee").agg(F.count("*").alias("n_calls"), F.countDistinct("line").alias("n_sites"), F.min("line").alias("first_line"))


def degrees(pairs: DataFrame) -> DataFrame:
    """In and out degree and drawn size of each node of (src, dst) pairs; a loop counts twice."""
    ends = pairs.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(pairs.select("dst", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return sums.withColumn("size", F.round(1.6 + F.least(F.lit(6.0), F.sqrt(F.col("n_in") + F.col("n_out"))), 2))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the least node that is reachable, edges taken both ways. Labels spread and are then shortened, so long chains take few rounds."""
    both = kept(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(pairs.select("dst", "src")).distinct())
    labels = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        spread = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "heard").alias("next"))
        spread = kept(spread)
        jump = spread.select(F.col("node").alias("next"), F.col("next").alias("further"))
        new = kept(spread.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("further", "next")).alias("next")))
        changed = new.filter("next <> label").count()
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")


def fewest_hops(pairs: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """(node, hops): the fewest edges, at most `most`, from any of starts (node), by a frontier that meets each node once."""
    links = kept(pairs.filter("src <> dst").select("src", "dst").distinct())
    frontier = kept(starts.select("node").distinct().withColumn("hops", F.lit(0).cast("bigint")))
    seen = frontier
    for hop in range(1, most + 1):
        reached = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = kept(reached.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop).cast("bigint")))
        seen = seen.unionByName(frontier)
    return seen


def callers_within_two(pairs: DataFrame) -> DataFrame:
    """How many other functions reach each node in one call, and in one or two."""
    links = pairs.filter("src <> dst").select("src", "dst").distinct()
    two = links.alias("x").join(links.alias("y"), F.col("x.src") == F.col("y.dst")).select(F.col("y.src").alias("src"), F.col("x.dst").alias("dst"), F.lit(2).alias("d"))
    near = two.filter("src <> dst").unionByName(links.withColumn("d", F.lit(1))).groupBy("src", "dst").agg(F.min("d").alias("d"))
    return near.groupBy(F.col("dst").alias("node")).agg(F.count_if(F.col("d") == 1).alias("direct"), F.count("*").alias("within_two"))


def shared_neighbour(pairs: DataFrame, links: DataFrame, end: str, other: str) -> DataFrame:
    """pairs (src, dst) with `bridge`: the least node of column `other` that links to both by column `end`."""
    one = links.select(F.col(end).alias("src"), F.col(other).alias("n"))
    two = links.select(F.col(end).alias("dst"), F.col(other).alias("n"))
    return pairs.join(one, "src").join(two, ["dst", "n"]).groupBy("src", "dst").agg(F.min("n").alias("bridge"))
