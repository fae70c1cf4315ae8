"""The path from where an alarm's index comes from to the alarm, for all alarms at once, a call a round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boundwright.operators.joins import last_before
from boundwright.sources.shared import written

HOPS, COMMON = 8, 2


def origin_paths(alarms: DataFrame, writes: DataFrame, parameters: DataFrame, callers: DataFrame) -> DataFrame:
    """(order_id, step, role, function, symbol, scope, line, gap), steps from the origin to the alarm.

    alarms: (order_id, fn, symbol, line); writes: (fn, symbol, line, seq); parameters: (fn, symbol); callers: the one call of each
    function (callee, caller, call_line, argument) that is followed. In a round every alarm stands in one function:

    * no function, at the alarm: one step, with the gaps unresolved_function and empty_path; a function met before: the path ends before it;
    * earlier writes of the symbol in it: its origin is the last of them (at the alarm itself: the alarm);
    * a parameter: on to the caller with the argument's symbol (none: gap arg_extract_failed, and the symbol as it was); no caller: gap no_caller;
    * anything else: at the alarm, the last write of the symbol anywhere before it if that is in another function and the name has
      more than COMMON letters; without that, and in any caller, gap missing_df.

    What a round leaves open is a table; rounds are HOPS at most.
    """
    firsts = written(writes.groupBy("fn", "symbol").agg(F.min("line").alias("first_write")), "firsts")
    known = parameters.select("fn", "symbol").distinct().withColumn("is_parameter", F.lit(True))
    calls = callers.select(F.col("callee").alias("fn"), "caller", "call_line", "argument")
    left = alarms.select("order_id", "fn", "symbol", "line", F.array().cast("array<string>").alias("visited"))
    rounds = []
    for hop in range(HOPS):
        met = left.filter(~F.coalesce(F.array_contains("visited", F.col("fn")), F.lit(False)))
        met = met.join(firsts, ["fn", "symbol"], "left").join(known, ["fn", "symbol"], "left").join(calls, "fn", "left")
        kind = (
            F.when(F.col("fn").isNull(), "unresolved").when(F.coalesce(F.col("first_write") < F.col("line"), F.lit(False)), "written")
            .when(F.col("is_parameter") & F.col("caller").isNull(), "no_caller").when(F.col("is_parameter"), "called").otherwise("other")
        )
        met = written(met.select("order_id", F.lit(hop).alias("hop"), "fn", "symbol", "line", "visited", kind.alias("kind"), "caller", "call_line", "argument"), "hop")
        rounds.append(met.drop("visited", "caller", "call_line"))
        left = met.filter("kind = 'called'").select("order_id", F.col("caller").alias("fn"), F.coalesce("argument", "symbol").alias("symbol"), F.col("call_line").alias("line"), F.concat("visited", F.array("fn")).alias("visited"))
        if left.isEmpty():
            break
    rows = written(reduce(DataFrame.union, rounds), "rows")
    place = F.struct(F.col("line").alias("at"), "seq", F.col("fn").alias("in"))
    far = rows.filter("hop > 0 AND kind = 'written'")
    near = last_before(far.withColumn("key", F.concat_ws("|", "fn", "symbol")), writes.withColumn("key", F.concat_ws("|", "fn", "symbol")), "key", "line", place)
    near = near.withColumn("line", F.col("found.at")).drop("key", "found")
    here = rows.filter("hop = 0 AND kind = 'other'").withColumnRenamed("symbol", "key")
    anywhere = last_before(here, writes.withColumnRenamed("symbol", "key"), "key", "line", place).withColumnRenamed("key", "symbol")
    is_global = F.coalesce((F.col("found.in") != F.col("fn")) & (F.length("symbol") > COMMON), F.lit(False))
    anywhere = written(anywhere.withColumn("kind", F.when(is_global, "global").otherwise("other")), "anywhere")
    origins = anywhere.filter("kind = 'global'").select("order_id", F.lit(1).alias("hop"), F.col("found.in").alias("fn"), "symbol", F.col("found.at").alias("line"), "kind", "argument")
    names = ["order_id", "hop", "fn", "symbol", "line", "kind", "argument"]
    rest = rows.filter("NOT (hop > 0 AND kind = 'written') AND NOT (hop = 0 AND kind = 'other')")
    every = reduce(DataFrame.unionByName, [rest.select(names), near.select(names), anywhere.select(names), origins.select(names)])
    of = Window.partitionBy("order_id")
    every = every.withColumn("step", F.row_number().over(of.orderBy(F.desc("hop"))).cast("bigint")).withColumn("deepest", F.max("hop").over(of))
    role = F.when(F.col("deepest") == 0, "origin_and_alarm").when(F.col("hop") == 0, "alarm").when(F.col("hop") == F.col("deepest"), "origin").otherwise("call")
    gap = (
        F.when(F.col("kind") == "unresolved", "unresolved_function,empty_path").when(F.col("kind") == "no_caller", "no_caller")
        .when((F.col("kind") == "called") & F.col("argument").isNull(), "arg_extract_failed").when(F.col("kind") == "other", "missing_df").otherwise("")
    )
    scope = F.when(F.col("kind").isin("called", "no_caller"), "parameter").when(F.col("kind") == "written", "local").when(F.col("kind") == "global", "global").otherwise("unknown")
    return every.select("order_id", "step", role.alias("role"), F.col("fn").alias("function"), "symbol", scope.alias("scope"), "line", gap.alias("gap"))
