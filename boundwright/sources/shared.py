"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the intermediate tables that this application has written and not released.
WRITTEN: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; one without belongs to the cluster's default file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder's path in the folder of spark.checkpoint.dir. Where none is set, a local session (tests) gets one of its own; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="boundwright-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{qualified(spark, base).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame, written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, label)
    WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, first: int = 0, last: int = 0) -> int:
    """Delete the intermediate tables that were written after the first so many and before the last so many, once no result needs them; how many are left."""
    upto = max(first, len(WRITTEN) - last)
    for folder in WRITTEN[first:upto]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del WRITTEN[first:upto]
    return len(WRITTEN)
