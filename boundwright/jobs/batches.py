"""Queries over batches of investigated alarms, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boundwright.functions import text as T
from boundwright.jobs.catalogue import EVIDENCE, SCORED, query, scored
from boundwright.operators import evaluation as E
from boundwright.operators import sessions as S
from boundwright.sources.projections import view


@query(
    """_v AS (SELECT 'tokens_used' AS metric, CAST(tokens_used AS DOUBLE) AS x FROM verdicts WHERE tokens_used <> 0 UNION ALL SELECT 'token_savings_percent', 100.0 * (order_id % 97) / 97 FROM verdicts WHERE order_id % 6 <> 0),
    _l AS (SELECT metric, count(*) AS n, list_sort(list(x)) AS v FROM _v GROUP BY metric)
    SELECT metric, n, round(list_sum(v) / n, 2) AS mean, round(v[n // 2 + 1], 6) AS median, round(v[least(n - 1, n * 95 // 100) + 1], 6) AS p95 FROM _l""",
    "verdicts",
)
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, upper median and 95th percentile of the tokens of a batch that are not zero, and of its savings that are known."""
    rows = view(spark, sf_dir, "verdicts")
    tokens = rows.filter("tokens_used <> 0").select(F.lit("tokens_used").alias("metric"), F.col("tokens_used").cast("double").alias("x"))
    savings = rows.filter("order_id % 6 <> 0").select(F.lit("token_savings_percent").alias("metric"), (100.0 * (F.col("order_id") % 97) / 97).alias("x"))
    stats = E.upper_quantiles(tokens.unionAll(savings), "x", "metric")
    return stats.select("metric", "n", "mean", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query(
    f"""{SCORED}, _o AS (SELECT order_id, CASE WHEN order_id % 13 = 0 THEN 'error' WHEN classification = 'review' THEN 'review' WHEN human LIKE 'true%' AND classification LIKE 'true%' THEN 'TP' WHEN human = 'false' AND classification = 'false' THEN 'TN'
      WHEN human = 'false' AND classification LIKE 'true%' THEN 'FP' WHEN human LIKE 'true%' AND classification = 'false' THEN 'FN' ELSE classification END AS outcome,
      CASE WHEN order_id % 7 <> 0 THEN order_id % 50 END AS size, order_id % 4 AS n_guards, order_id % 3 AS n_gaps, order_id % 60 AS elapsed FROM _s),
    _g AS (SELECT outcome, count(*) AS n, count(*) FILTER (n_guards > 0) AS with_guards, count(*) FILTER (n_gaps > 0) AS with_gaps, count(size) AS n_sizes, count(DISTINCT size) AS n_distinct, min(size) AS least, max(size) AS most,
      round_even(sum(elapsed) / count(*), 2) AS mean_elapsed, list_sort(list(size) FILTER (size IS NOT NULL)) AS v FROM _o GROUP BY outcome)
    SELECT outcome, n, with_guards, with_gaps, n_sizes, n_distinct, least, most, v[n_sizes // 2 + 1] AS median, mean_elapsed FROM _g""",
    "verdicts",
    "truth",
)
def outcome_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each outcome: alarms, those with guards, gaps and a known size, the sizes' range, upper median and distinct values, and the mean time."""
    number = F.col("order_id")
    outcome = F.when(number % 13 == 0, "error").otherwise(E.outcome(F.col("human"), F.col("classification")))
    size = F.when(number % 7 != 0, number % 50)
    rows = scored(spark, sf_dir).select(outcome.alias("outcome"), size.alias("size"), (number % 4).alias("n_guards"), (number % 3).alias("n_gaps"), (number % 60).alias("elapsed"))
    sums = rows.groupBy("outcome").agg(
        F.count("*").alias("n"), F.count_if(F.col("n_guards") > 0).alias("with_guards"), F.count_if(F.col("n_gaps") > 0).alias("with_gaps"), F.count("size").alias("n_sizes"),
        F.countDistinct("size").alias("n_distinct"), F.min("size").alias("least"), F.max("size").alias("most"), F.bround(F.sum("elapsed") / F.count("*"), 2).alias("mean_elapsed"),
    )
    return sums.join(E.upper_quantiles(rows, "size", "outcome").select("outcome", "median"), "outcome", "left")


@query(
    """_r AS (SELECT order_id, seq, tool, tool = 'submit_verdict' AND (order_id + seq) % 2 = 0 AS accepted, tool = 'submit_verdict' AND (order_id + seq) % 2 <> 0 AS rejected, CASE WHEN tool = 'inspect' THEN concat('fn_', seq % 5) END AS helper, (order_id + seq) % 11 = 0 AS gave_up FROM tool_events)
    SELECT order_id, count(*) AS n_calls, count(*) FILTER (rejected) AS n_rejects, bool_or(accepted) AS accepted, coalesce(array_to_string(list_sort(list(DISTINCT helper) FILTER (helper IS NOT NULL)), ','), '') AS inspected,
    NOT bool_or(accepted) AND bool_or(gave_up) AS failed_to_converge FROM _r GROUP BY order_id""",
    "tool_events",
)
def session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session: calls, rejected and accepted submissions, inspected functions, and whether it failed to converge. Every task adds up what it has of a session."""
    number = F.col("order_id") + F.col("seq")
    submitted = F.col("tool") == "submit_verdict"
    accepted = F.bool_or(submitted & (number % 2 == 0))
    helper = F.when(F.col("tool") == "inspect", F.concat(F.lit("fn_"), (F.col("seq") % 5).cast("string")))
    return view(spark, sf_dir, "tool_events").groupBy("order_id").agg(
        F.count("*").alias("n_calls"), F.count_if(submitted & (number % 2 != 0)).alias("n_rejects"), accepted.alias("accepted"),
        F.array_join(F.array_sort(F.collect_set(helper)), ",").alias("inspected"), (~accepted & F.bool_or(number % 11 == 0)).alias("failed_to_converge"),
    )


@query(
    """SELECT order_id % 5000 AS order_number, max(order_id) AS row_id, arg_max(category, order_id) AS category, arg_max(classification, order_id) AS classification, count(*) AS n_rows FROM alarms GROUP BY 1""",
    "alarms",
)
def alarms_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the export rows of an order number the last one."""
    rows = view(spark, sf_dir, "alarms").groupBy((F.col("order_id") % 5000).alias("order_number"))
    return rows.agg(F.max("order_id").alias("row_id"), F.max_by("category", "order_id").alias("category"), F.max_by("classification", "order_id").alias("classification"), F.count("*").alias("n_rows"))


@query(
    f"""_ev AS ({EVIDENCE}),
    _a AS (SELECT v.order_id, CASE v.classification WHEN 'false' THEN 'FP' WHEN 'true' THEN 'bug' WHEN 'true (low)' THEN 'Potential ' WHEN 'review' THEN 'uncertain' ELSE CASE WHEN v.order_id % 3 = 0 THEN 'nonsense' ELSE 'u' END END AS raw,
      v.confidence, e.* EXCLUDE (order_id), v.order_id % 17 = 0 AS force_review, v.order_id % 3 = 0 AS no_reason, v.order_id % 2 = 0 AS gaps, v.order_id % 4 = 0 AS missing_df, CASE WHEN v.order_id % 7 <> 0 THEN 8 END AS size, v.order_id % 16 AS derived_max,
      v.order_id % 10 = 0 AS own_guard, v.order_id % 9 = 0 AS counterargument FROM verdicts v JOIN _ev e ON v.order_id = e.order_id),
    _n AS (SELECT *, CASE raw WHEN 'FP' THEN 'false' WHEN 'bug' THEN 'true' WHEN 'Potential ' THEN 'true (low)' WHEN 'uncertain' THEN 'review' WHEN 'u' THEN 'undecided' END AS alias FROM _a),
    _c AS (SELECT *, CASE WHEN alias IS NOT NULL AND force_review THEN 'review' ELSE alias END AS cls FROM _n)
    SELECT order_id, cls AS class, CASE WHEN cls IS NULL THEN 'unknown_class' WHEN cls = 'review' AND NOT force_review AND no_reason THEN 'review_needs_reason' WHEN cls <> 'review' AND NOT simulated THEN 'simulation_required'
    WHEN gaps AND NOT gaps_addressed AND cls NOT IN ('review', 'undecided') THEN 'gaps_unaddressed' WHEN cls = 'false' AND gaps AND ((missing_df AND derived_max >= size) OR own_guard) THEN 'structural_block'
    WHEN coalesce(confidence, 'medium') = 'medium' AND cls NOT IN ('review', 'undecided') AND NOT counterargument THEN 'counterargument_needed'
    WHEN cls NOT IN ('review', 'undecided') AND coalesce(confidence_so_far, 'low') <> 'high' AND NOT forced THEN 'confidence_not_high' WHEN cls IN ('true', 'false') AND size IS NULL THEN 'unknown_capacity' ELSE 'accepted' END AS gate FROM _c""",
    "verdicts",
    "tool_events",
)
def submission_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that each submission by an alias ends with, after a forced review, and the first of all gates that rejects it."""
    rows = view(spark, sf_dir, "verdicts").join(S.evidence(view(spark, sf_dir, "tool_events")), "order_id")
    number, own = F.col("order_id"), F.col("classification")
    raw = F.when(own == "false", "FP").when(own == "true", "bug").when(own == "true (low)", "Potential ").when(own == "review", "uncertain").otherwise(F.when(number % 3 == 0, "nonsense").otherwise("u"))
    forced = number % 17 == 0
    taken = S.forced_review(T.normal_class(raw), forced)
    reason = F.when((number % 3 != 0) | forced, "a reason")
    size = F.when(number % 7 != 0, 8)
    blocked = S.blocks_false(number % 2 == 0, number % 4 == 0, number % 16, size, number % 10 == 0)
    stopped = S.gate(taken, reason, number % 2 == 0, size, blocked=blocked, confidence=F.col("confidence"), counterargument=number % 9 == 0)
    return rows.select("order_id", taken.alias("class"), stopped.alias("gate"))
