"""Evaluation of verdicts against human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("batch", "population", "calibration")


def is_true(label: Column) -> Column:
    return F.lower(label).startswith("true")


def confusion(rows: DataFrame) -> DataFrame:
    """One row for each scoring policy over rows (human, classification).

    batch: only `true` is positive; population: `true (low)` is too; calibration: a review of a true alarm
    counts as found.
    """
    human, own = is_true(F.col("human")), F.col("classification")
    positive = {"batch": own == "true", "population": own.isin("true", "true (low)"), "calibration": own.isin("true", "true (low)", "review")}
    sums = []
    for name in POLICIES:
        hit, negative = positive[name], own == "false"
        for label, test in (("tp", human & hit), ("fp", ~human & hit), ("tn", ~human & negative), ("fn", human & negative)):
            sums.append(F.count_if(test).alias(f"{name}_{label}"))
    one = rows.agg(F.count("*").alias("n_scored"), F.count_if(own == "review").alias("n_review"), *sums)
    fields = [F.struct(F.lit(n).alias("policy"), *(F.col(f"{n}_{x}").alias(x) for x in ("tp", "fp", "tn", "fn"))) for n in POLICIES]
    flat = one.select("n_scored", "n_review", F.explode(F.array(*fields)).alias("p")).select("p.policy", "n_scored", "n_review", "p.tp", "p.fp", "p.tn", "p.fn")
    right = F.col("tp") + F.col("tn")
    decided = right + F.col("fp") + F.col("fn")
    return flat.withColumns({"accuracy_all": F.round(F.try_divide(right, "n_scored"), 6), "accuracy_decided": F.round(F.try_divide(right, decided), 6)})


def outcome(human: Column, own: Column) -> Column:
    """review, TP, TN, FP, FN, or the class itself."""
    out = F.when(own == "review", "review").when(is_true(human) & own.startswith("true"), "TP").when(~is_true(human) & (own == "false"), "TN")
    return out.when(~is_true(human) & own.startswith("true"), "FP").when(is_true(human) & (own == "false"), "FN").otherwise(own)


def calibration(rows: DataFrame) -> DataFrame:
    """For each confidence: scored rows, share that matches, and true alarms called false."""
    human, own = is_true(F.col("human")), F.col("classification")
    match = F.when(human, own.startswith("true") | (own == "review")).otherwise(own == "false")
    sums = rows.groupBy(F.lower(F.coalesce("confidence", F.lit("unknown"))).alias("confidence")).agg(F.count("*").alias("n"), F.count_if(match).alias("m"), F.count_if(human & (own == "false")).alias("false_on_human_true"))
    return sums.select("confidence", "n", F.bround(F.col("m") / F.col("n"), 6).alias("match_rate"), "false_on_human_true")


def upper_quantiles(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Mean, and the values at places n // 2 and min(n - 1, floor(0.95 n)) of each group's sorted values, exactly.

    Values are counted first, so the running counts below are over distinct values of a group.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(group).orderBy(value)
    placed = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    n = F.col("n")
    return placed.groupBy(group, "n").agg(F.bround(F.sum(F.col(value) * F.col("c")) / n, 2).alias("mean"), at(F.floor(n / 2)).alias("median"), at(F.least(n - 1, F.floor(n * 95 / 100))).alias("p95"))


def recall_violations(rows: DataFrame) -> DataFrame:
    """True alarms whose verdict is false."""
    return rows.filter(is_true(F.col("human")) & (F.col("classification") == "false")).select("order_id", "human", "classification")


def top_clusters(rows: DataFrame, key: str, first: str, k: int) -> DataFrame:
    """The k commonest values of a column, ties by the least `first`, each with its true alarms."""
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(first).alias("first_seen"), F.count_if(is_true(F.col("classification"))).alias("n_true"))
    return sums.orderBy(F.desc("n"), "first_seen").limit(k)


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Count and percentage of each value; the total is a scalar subquery."""
    return rows.sparkSession.sql(f"SELECT {key}, count(*) AS n, round(count(*) * 100.0D / (SELECT count(*) FROM {{rows}}), 2) AS percent FROM {{rows}} GROUP BY {key}", rows=rows)


def spread(order_id: Column, seed: int) -> Column:
    """A number that orders ids as if at random, by arithmetic that any engine can repeat."""
    return (order_id * 7919 + seed * 104729) % 1000003


def sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """All true alarms, then false ones in the seed's order, up to n in all."""
    order = F.when(is_true(F.col("human")), -1).otherwise(spread(F.col("order_id"), seed))
    kept = rows.filter(is_true(F.col("human")))
    filled = rows.orderBy(order, "order_id").limit(n)
    return kept.union(filled).distinct()


def stratified(rows: DataFrame, quotas: dict[str, int], seed: int) -> DataFrame:
    """The first of each stratum in the seed's order, as many as its quota."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("human").orderBy(spread(F.col("order_id"), seed), "order_id")))
    most = F.lit(0)
    for name, quota in quotas.items():
        most = F.when(F.col("human") == name, quota).otherwise(most)
    return ranked.filter(F.col("rank") <= max(quotas.values())).filter(F.col("rank") <= most).select("order_id", "human", F.col("rank").cast("bigint").alias("rank"))
