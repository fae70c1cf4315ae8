"""A sink that survives repeated and torn writes, for streams and for long batches.

Results lie in one folder a step (`step=<n>`), each written as a whole. A step that is repeated replaces its folder, so its rows are
there once; a folder without its success marker is a torn write and counts as empty. Nothing but the list of folders comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_SUCCESS"


def folder(path: str, step: int) -> str:
    return f"{path.rstrip('/')}/step={step}"


def put(rows: DataFrame, path: str, step: int) -> None:
    """Write a step's rows, in place of what it may have left before."""
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", True).parquet(folder(path, step))


def finished(spark: SparkSession, path: str) -> list[int]:
    """The steps that are written as a whole; none where the path is missing."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    names = [s.getPath() for s in files.listStatus(top) if s.isDirectory() and s.getPath().getName().startswith("step=")]
    return sorted(int(p.getName()[5:]) for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, MARK)))


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of whole steps, with `step`; an empty table where there is none yet."""
    steps = finished(spark, path)
    if not steps:
        return spark.createDataFrame([], f"{schema}, step int")
    return spark.read.schema(f"{schema}, step int").option("basePath", path).parquet(*(folder(path, s) for s in steps))


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key the row of its last step (the greatest of equal ones), as a retried key has several."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct("step", *(c for c in others if c != "step"))).alias("r")).select(key, "r.*")


def remaining(todo: DataFrame, done: DataFrame, key: str, ok: str = "error IS NULL AND verdict IN ('true', 'false', 'review')") -> DataFrame:
    """What is left to do: keys without a result, and those whose last result is not ok (it has an error, or no verdict that ends a case)."""
    return todo.join(latest(done, key).filter(ok).select(key), key, "left_anti")


def stepwise(todo: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str, steps: int) -> list[int]:
    """Do the work in so many steps, by a hash of the key; steps that are whole already are left out. Returns the steps that were done."""
    before = set(finished(todo.sparkSession, path))
    dealt = todo.withColumn("_step", F.pmod(F.xxhash64(key), F.lit(steps)))
    did = []
    for step in sorted(set(range(steps)) - before):
        put(work(dealt.filter(F.col("_step") == step).drop("_step")), path, step)
        did.append(step)
    return did


def streamed(rows: DataFrame, path: str, state: str):
    """Start writing a stream's batches as steps. A batch that runs again after a failure has the same number, so it replaces its step."""
    return rows.writeStream.foreachBatch(lambda batch, number: put(batch, path, number)).option("checkpointLocation", state).trigger(availableNow=True).start()
