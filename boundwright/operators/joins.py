"""Joins on line numbers that shuffle on a bucket of lines, so no key and no span meets all rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines in a bucket; of functions and what stands in them.
WIDTH, SPAN = 4096, 256


def enclosing(points: DataFrame, spans: DataFrame, line: str = "line", width: int = SPAN) -> DataFrame:
    """points with fn_id, name, start_line and end_line of the innermost span (the greatest start; then the greatest fn_id) around each line; nulls where there is none.

    A span is dealt to every bucket it touches, a point to its own; copies of a line are looked up once.
    """
    lines = points.select(F.col(line).alias("at")).filter("at IS NOT NULL").distinct().withColumn("bucket", F.floor(F.col("at") / width))
    cut = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    met = lines.join(cut, "bucket").filter("at BETWEEN start_line AND end_line")
    best = met.groupBy("at").agg(F.max(F.struct("start_line", "fn_id", "name", "end_line")).alias("s")).select("at", "s.fn_id", "s.name", "s.start_line", "s.end_line")
    return points.join(best, points[line] == best["at"], "left").drop("at")


def beside(left: DataFrame, right: DataFrame, key: str, line: str, value: Column, width: int, after: bool = False) -> DataFrame:
    """left with `before`: line l and value v of the key's latest right row on a smaller line, the greatest value of equal lines; with `after` also those of the first on its own or a later line.

    Both tables are shuffled once, by key and bucket of lines, and stand side by side in a window; across buckets one carried row for each key and bucket goes on, so a
    key with many rows is many groups.
    """
    bucket = F.floor(F.col(line) / width).alias("bucket")
    marked = right.filter(F.col(key).isNotNull() & F.col(line).isNotNull()).select(F.col(key), F.col(line), bucket, F.struct(F.col(line).alias("l"), value.alias("v")).alias("own"))
    own, row = F.lit(None).cast(marked.schema["own"].dataType), F.struct(*(F.col(c) for c in left.columns))
    both = left.select(F.col(key), F.col(line), bucket, own.alias("own"), row.alias("row")).unionByName(marked.withColumn("row", F.lit(None).cast(left.schema)))
    of, ends = Window.partitionBy(key, "bucket"), marked.groupBy(key, "bucket").agg(F.max("own").alias("last"), F.min("own").alias("first"))
    ends = left.select(F.col(key), bucket).distinct().join(ends, [key, "bucket"], "full")
    over = Window.partitionBy(key).orderBy("bucket")
    found = {"before": (F.max("own").over(of.orderBy(line).rangeBetween(Window.unboundedPreceding, -1)), F.last("last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))}
    if after:
        down = Window.partitionBy(key).orderBy(F.desc("bucket"))
        found["after"] = F.min("own").over(of.orderBy(F.desc(line)).rangeBetween(Window.unboundedPreceding, 0)), F.last("first", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    near = both.withColumns({name: here for name, (here, _) in found.items()}).filter(F.col("row").isNotNull())
    carried = ends.select(key, "bucket", *(there.alias(f"{name}_far") for name, (_, there) in found.items()))
    out = near.join(carried, [key, "bucket"], "left")
    return out.select("row.*", *(F.coalesce(name, f"{name}_far").alias(name) for name in found))


def last_before(left: DataFrame, right: DataFrame, key: str, line: str, value: Column, width: int = WIDTH) -> DataFrame:
    """left with `found`: the value of the latest right row of the key with a smaller line; null if there is none. The greatest value of equal lines."""
    return beside(left, right, key, line, value, width).withColumn("found", F.col("before.v")).drop("before")


def nearest(left: DataFrame, right: DataFrame, key: str, line: str, width: int = WIDTH) -> DataFrame:
    """left with `found`: the line of the key's right row nearest to its own, the smaller of two; null where the key has none."""
    both = beside(left, right, key, line, F.col(line), width, after=True)
    before, after = F.col("before.v"), F.col("after.v")
    return both.withColumn("found", F.when(F.col(line) - before <= after - F.col(line), before).otherwise(F.coalesce(after, before))).drop("before", "after")


def first_of(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with `rank`. Spark cuts each task's rows to k a key before it shuffles them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= k)


def running_before(left: DataFrame, right: DataFrame, keys: list[str], line: str) -> DataFrame:
    """left with `before`: how many right rows of its keys have a smaller line. Rows of a line are counted before the window."""
    counts = right.groupBy(*keys, line).agg(F.count("*").alias("n"))
    asked = left.select(*keys, line).distinct().withColumn("n", F.lit(0).cast("bigint"))
    both = asked.unionByName(counts).groupBy(*keys, line).agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy(line).rowsBetween(Window.unboundedPreceding, -1)
    return left.join(both.select(*keys, line, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), [*keys, line], "left")
