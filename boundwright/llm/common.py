"""What the operators share: reading tables, the cluster's shared folder, and bounded Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boundwright.sources.shared import released, shared_dir, written

__all__ = ["bounded_batches", "checkpointed", "released", "shared_dir", "table", "written"]

#: Bounds on what a Python worker holds of a table at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, so that long texts do not add up.

    Spark has these bounds for a session only, where they hold for other queries too. All operators set the same ones,
    and only where they are tighter than what the session has; results do not depend on them.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, checkpointed in the shared folder: as written(), but it keeps its partitions and their order."""
    shared_dir(df.sparkSession, "checkpoint")
    return df.checkpoint()
