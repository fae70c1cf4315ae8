"""The event stream of investigations as a Structured Streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "order_id long, seq long, tool string, confidence string, ts timestamp"


def running_evidence(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each session's evidence so far, from a stream of events with a time `ts`; repeated events (order_id, seq) within the watermark count once.

    Write it in update mode: every batch gives the sessions that changed. State is one row a session.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["order_id", "seq"])
    stated = F.when(F.col("confidence").isNotNull(), F.col("seq"))
    return once.groupBy("order_id").agg(
        F.count("*").alias("n_calls"),
        F.bool_or(F.col("tool") == "run_simulation").alias("simulated"),
        F.max_by("confidence", stated).alias("confidence_so_far"),
    )
