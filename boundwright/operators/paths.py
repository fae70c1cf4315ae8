"""Paths in call graphs, found for all asked pairs at once. Of equally short paths the least by node names is taken.

A round extends every path by an edge and is written to the shared folder; only counts come to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundwright.operators.joins import first_of
from boundwright.sources.shared import written

#: Edges of a bridge, edges of a listed path, and listed paths of a pair.
BRIDGE, LONGEST, LISTED = 5, 6, 12


def plain(edges: DataFrame) -> DataFrame:
    """The distinct edges (src, dst) without loops."""
    return written(edges.select("src", "dst").filter("src <> dst").distinct(), "links")


def both_ways(links: DataFrame) -> DataFrame:
    return written(links.union(links.select("dst", "src")).distinct(), "links")


def shortest(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(start, node, path) of every node that starts (start) reach with at most `most` edges: the least of its shortest paths.

    A least path goes on from the least path to the node before, so one path a start and node is kept.
    """
    frontier = written(starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct(), "frontier")
    found = [frontier]
    seen = frontier.select("start", "node")
    for _ in range(most):
        steps = frontier.join(links, frontier["node"] == links["src"]).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = steps.groupBy("start", "node").agg(F.min("path").alias("path"))
        frontier = written(new.join(seen, ["start", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        found.append(frontier)
        seen = seen.union(frontier.select("start", "node"))
    return reduce(DataFrame.union, found)


def least_shared(asked: DataFrame, links: DataFrame, end: str, other: str) -> DataFrame:
    """(a, b, bridge): the least node of column `other` that links to both by column `end`. Of a node that many link to, only those asked for meet."""
    one = links.select(F.col(end).alias("a"), F.col(other).alias("n"))
    two = links.select(F.col(end).alias("b"), F.col(other).alias("n"))
    return asked.join(one, "a").join(two, ["b", "n"]).groupBy("a", "b").agg(F.min("n").alias("bridge"))


def segments(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, kind, nodes) of the asked pairs: how the graph connects them, the first that applies.

    disconnected (an end is no node), same_node, direct, directed_bridge and reverse_bridge (at most BRIDGE edges, nodes from a to b),
    shared_caller, shared_callee, undirected_bridge, disconnected.
    """
    asked = written(asked.select("a", "b").distinct(), "asked")
    links = plain(edges)
    known = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
    is_known = lambda c: known.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_known"))
    rows = asked.join(is_known("a"), "a", "left").join(is_known("b"), "b", "left")
    ways = {
        "directed": shortest(links, asked.select(F.col("a").alias("start")), BRIDGE).select(F.col("start").alias("a"), F.col("node").alias("b"), F.col("path").alias("directed")),
        "reverse": shortest(links, asked.select(F.col("b").alias("start")), BRIDGE).select(F.col("start").alias("b"), F.col("node").alias("a"), F.reverse("path").alias("reverse")),
        "undirected": shortest(both_ways(links), asked.select(F.col("a").alias("start")), BRIDGE).select(F.col("start").alias("a"), F.col("node").alias("b"), F.col("path").alias("undirected")),
        "caller": least_shared(asked, links, "dst", "src").select("a", "b", F.array("a", "bridge", "b").alias("caller")),
        "callee": least_shared(asked, links, "src", "dst").select("a", "b", F.array("a", "bridge", "b").alias("callee")),
    }
    for way in ways.values():
        rows = rows.join(way, ["a", "b"], "left")
    missing = F.col("a_known").isNull() | F.col("b_known").isNull()
    kinds = (
        (missing, "disconnected", F.array().cast("array<string>")),
        (F.col("a") == F.col("b"), "same_node", F.array("a")),
        (F.size("directed") == 2, "direct", F.col("directed")),
        (F.col("directed").isNotNull(), "directed_bridge", F.col("directed")),
        (F.col("reverse").isNotNull(), "reverse_bridge", F.col("reverse")),
        (F.col("caller").isNotNull(), "shared_caller", F.col("caller")),
        (F.col("callee").isNotNull(), "shared_callee", F.col("callee")),
        (F.col("undirected").isNotNull(), "undirected_bridge", F.col("undirected")),
    )
    kind, nodes = F.lit("disconnected"), F.array().cast("array<string>")
    for test, name, path in reversed(kinds):
        kind, nodes = F.when(test, name).otherwise(kind), F.when(test, path).otherwise(nodes)
    return rows.select("a", "b", kind.alias("kind"), nodes.alias("nodes"))


def listed(links: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, rank, path): the first LISTED simple paths of at most LONGEST edges, shorter ones first, equals by their nodes.

    A path only goes on to nodes from which its end can still be reached in the edges that are left.
    """
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reach = shortest(turned, asked.select(F.col("b").alias("start")), LONGEST).select(F.col("start").alias("b"), "node", (F.size("path") - 1).alias("left"))
    reach = written(reach, "reach")
    open_ = written(asked.filter("a <> b").select("a", "b", F.col("a").alias("node"), F.array("a").alias("path")), "open")
    found = []
    for edge in range(1, LONGEST + 1):
        steps = open_.join(links, open_["node"] == links["src"]).filter(~F.array_contains("path", F.col("dst")))
        steps = steps.select("a", "b", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        open_ = written(steps.join(reach, ["b", "node"]).filter(F.col("left") <= LONGEST - edge).drop("left"), "open")
        found.append(open_.filter("node = b").select("a", "b", "path"))
        open_ = open_.filter("node <> b")
    return first_of(reduce(DataFrame.union, found), ["a", "b"], [F.size("path").asc(), F.asc("path")], LISTED)


def simple_paths(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, directed, rank, n_nodes, path) of the asked pairs: paths along the edges or, where a pair has none, along and against them."""
    asked = written(asked.select("a", "b").distinct(), "asked")
    links = plain(edges)
    along = written(listed(links, asked).withColumn("directed", F.lit(True)), "along")
    rest = written(asked.join(along.select("a", "b").distinct(), ["a", "b"], "left_anti"), "rest")
    against = listed(both_ways(links), rest).withColumn("directed", F.lit(False))
    return along.unionByName(against).select("a", "b", "directed", "rank", F.size("path").cast("bigint").alias("n_nodes"), "path")
