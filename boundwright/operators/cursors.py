"""The cursor of an investigation over its path, and verdicts that answer for structurally equal alarms.

Both are folds over events in order; the streaming versions (boundwright.streaming.state) take the same steps as events arrive.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that move the cursor, and what opens the step it is at.
FORWARD, BACK = ("next", "forward", "toward_alarm", "callee"), ("prev", "previous", "back", "caller")
MOVE, OPEN = "move_window", "get_micro_window"


def moved(cursor: int, n_steps: int, direction: str | None, step: int | None) -> int | None:
    """Where a move leads from a cursor (from 0) on a path of n steps; None for an unknown word. A step other than 0 goes before the word."""
    if step:
        return min(max(1, step), n_steps) - 1
    word = (direction or "next").strip().lower()
    return min(cursor + 1, n_steps - 1) if word in FORWARD else max(cursor - 1, 0) if word in BACK else None


def cursors(events: DataFrame) -> DataFrame:
    """order_id, at_step (from 1), n_moves, n_errors, opened (steps, ascending) of events (order_id, seq, n_steps, tool, direction, step).

    A session is one list: its calls are few by the ceiling that ends it. Repeated (order_id, seq) count once.
    """
    own = F.struct("seq", "n_steps", "tool", "direction", "step")
    lists = events.filter(F.col("tool").isin(MOVE, OPEN)).groupBy("order_id").agg(F.array_sort(F.collect_set(own)).alias("events"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("moves"), F.lit(0).cast("long").alias("errors"), F.array().cast("array<long>").alias("opened"))

    def step(state: Column, e: Column) -> Column:
        word = F.lower(F.trim(F.when(F.coalesce(e["direction"], F.lit("")) == "", "next").otherwise(e["direction"])))
        last = e["n_steps"] - 1
        to = (
            F.when(F.coalesce(e["step"], F.lit(0)) != 0, F.least(F.greatest(e["step"], F.lit(1)), e["n_steps"]) - 1)
            .when(word.isin(*FORWARD), F.least(state["at"] + 1, last)).when(word.isin(*BACK), F.greatest(state["at"] - 1, F.lit(0)))
        )
        moves = e["tool"] == MOVE
        return F.struct(
            F.when(moves, F.coalesce(to, state["at"])).otherwise(state["at"]).alias("at"),
            (state["moves"] + (moves & to.isNotNull()).cast("long")).alias("moves"),
            (state["errors"] + (moves & to.isNull()).cast("long")).alias("errors"),
            F.when(moves, state["opened"]).otherwise(F.array_union(state["opened"], F.array(state["at"] + 1))).alias("opened"),
        )

    folded = lists.select("order_id", F.aggregate("events", zero, step).alias("s"))
    return folded.select("order_id", (F.col("s.at") + 1).alias("at_step"), F.col("s.moves").alias("n_moves"), F.col("s.errors").alias("n_errors"), F.array_sort("s.opened").alias("opened"))


def answered(known: tuple | None, case: tuple) -> tuple[tuple, tuple]:
    """What is known of a fingerprint after a case (order_id, classification, tag), and the case's answer (derived_from, classification).

    The verdict that is known answers, unless there is none or it is false, or the case has a tag of its own that differs;
    then the case is investigated, and its verdict is what is known from there on.
    """
    order_id, classification, tag = case
    if known is None or known[0] == order_id or (known[1] or "").lower() == "false" or (tag and tag != (known[2] or "")):
        return case, (None, classification)
    return known, (known[0], known[1])


ANSWERS = "order_id long, fingerprint string, derived_from long, classification string"


def in_order(cases: Iterable[tuple], known: tuple | None) -> Iterator[tuple[tuple | None, tuple]]:
    for case in cases:
        known, answer = answered(known, case)
        yield known, answer


def answers(cases: DataFrame) -> DataFrame:
    """ANSWERS for cases (order_id, fingerprint, finished, classification, tag), by fingerprint in order of (finished, order_id).

    Rows stream through in order, and only what is known of the fingerprint at hand is held, however many cases it has.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known = None, None
        for frame in frames:
            out = []
            for order_id, fingerprint, classification, tag in zip(frame["order_id"], frame["fingerprint"], frame["classification"], frame["tag"], strict=True):
                if fingerprint != at:
                    at, known = fingerprint, None
                known, (derived, answer) = answered(known, (int(order_id), classification, tag))
                out.append((order_id, fingerprint, derived, answer))
            made = pd.DataFrame(out, columns=["order_id", "fingerprint", "derived_from", "classification"])
            yield made.assign(derived_from=made["derived_from"].astype("Int64"))

    dealt = cases.repartition("fingerprint").sortWithinPartitions("fingerprint", "finished", "order_id")
    return dealt.select("order_id", "fingerprint", "classification", "tag").mapInPandas(run, ANSWERS)
