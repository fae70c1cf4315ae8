"""Evidence of tool events, one session an alarm, and the gates that admit or reject a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tools that answer gaps, and the ceiling of tool calls.
GAP_TOOLS, CEILING = ("query_call_graph", "query_data_flow", "inspect"), 20


def evidence(events: DataFrame) -> DataFrame:
    """One row a session: calls, tools, whether simulated and gaps addressed, the latest stated confidence, and whether the ceiling forces an end."""
    tool = F.col("tool")
    stated = F.when(F.col("confidence").isNotNull(), F.col("seq"))
    out = events.groupBy("order_id").agg(
        F.count("*").alias("n_calls"),
        F.array_join(F.array_sort(F.collect_set("tool")), ",").alias("tools"),
        F.coalesce(F.bool_or(tool == "run_simulation"), F.lit(False)).alias("simulated"),
        F.coalesce(F.bool_or(tool.isin(*GAP_TOOLS)), F.lit(False)).alias("gaps_addressed"),
        F.count_if(tool == "submit_verdict").alias("n_submits"),
        F.max_by("confidence", stated).alias("confidence_so_far"),
    )
    forced = (F.col("n_calls") >= CEILING) & ~((F.coalesce("confidence_so_far", F.lit("low")) == "high") & F.col("simulated"))
    return out.withColumn("forced", forced)


def forced_review(classification: Column, forced: Column) -> Column:
    """A known class, or review where the session forces it; an unknown one stays null."""
    return F.when(classification.isNotNull() & forced, "review").otherwise(classification)


def blocks_false(gaps: Column, missing_flow: Column, derived_max: Column, size: Column, own_guard: Column) -> Column:
    """Whether the case's structure keeps a verdict from being false: with gaps, an index that no write explains and that reaches the capacity, or a guard of the alarm's function that itself reads the array by the operand."""
    reaches = F.coalesce(derived_max >= size, F.lit(False))
    return gaps & ((missing_flow & reaches) | own_guard)


def gate(classification: Column, reason: Column, gaps: Column, size: Column, blocked: Column | None = None, confidence: Column | None = None, counterargument: Column | None = None) -> Column:
    """The first gate that rejects a verdict, over columns of `evidence`; `accepted` if none does.

    blocked: see `blocks_false`; confidence: that of the submission, medium if it is none of the three; counterargument: whether one was given, in this round or before.
    """
    decisive = ~classification.isin("review", "undecided")
    stated = F.lower(F.trim(F.coalesce(confidence, F.lit("medium")))) if confidence is not None else F.lit("high")
    medium = ~stated.isin("low", "high")
    chain = (
        ("unknown_class", classification.isNull()),
        ("review_needs_reason", (classification == "review") & (F.coalesce(F.trim(reason), F.lit("")) == "")),
        ("simulation_required", (classification != "review") & ~F.col("simulated")),
        ("gaps_unaddressed", gaps & ~F.col("gaps_addressed") & decisive),
        ("structural_block", (classification == "false") & (blocked if blocked is not None else F.lit(False))),
        ("counterargument_needed", medium & decisive & ~(counterargument if counterargument is not None else F.lit(False))),
        ("confidence_not_high", decisive & (F.coalesce("confidence_so_far", F.lit("low")) != "high") & ~F.col("forced")),
        ("unknown_capacity", classification.isin("true", "false") & size.isNull()),
    )
    out = F.lit("accepted")
    for name, rejects in reversed(chain):
        out = F.when(rejects, name).otherwise(out)
    return out
