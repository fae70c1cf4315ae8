"""Investigations as keyed state: the cursor of each session, and verdicts that answer for equal alarms, as events arrive.

Events are held until the watermark has passed them, then taken in the order they have in themselves, so the order of arrival
and the cut into batches do not matter. State needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from boundwright.operators import cursors as C

SESSIONS = "order_id long, at_step long, n_moves long, n_errors long, opened array<long>"
MOVES = "order_id long, seq long, n_steps long, tool string, direction string, step long, ts timestamp"
CASES = "order_id long, fingerprint string, classification string, tag string, ts timestamp"


class Held(StatefulProcessor):
    """Holds a key's events in a list until the watermark has passed them; a timer for the earliest then takes all that are due, in order."""

    columns: list[str]
    schema: str

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.timer = handle.getValueState("timer", "at long")

    def wait(self, events: list[tuple]) -> None:
        self.held.put(events) if events else self.held.clear()
        self.timer.clear()
        if events:
            at = min(e[0] for e in events)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = list(self.held.get()) if self.held.exists() else []
        for frame in rows:
            at = (frame["ts"].astype("int64") // (10**6 if str(frame["ts"].dtype).startswith("datetime64[ns") else 10**3)).tolist()
            # A column of whole numbers with nulls comes as one of floats.
            values = [[None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in frame[c].tolist()] for c in self.columns]
            events += [e for e in zip(at, *values, strict=True) if e[0] > passed]
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.wait(events)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = list(self.held.get())
        due = [e for e in events if e[0] <= passed]
        self.timer.clear()
        self.wait([e for e in events if e[0] > passed])
        yield from self.take(key, due)

    def take(self, key, events: list[tuple]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Cursor(Held):
    columns, schema = ["seq", "n_steps", "tool", "direction", "step"], "at long, seq long, n_steps long, tool string, direction string, step long"

    def init(self, handle) -> None:
        super().init(handle)
        self.session = handle.getValueState("session", "at long, moves long, errors long, seq long")
        self.opened = handle.getListState("opened", "step long")

    def take(self, key, events: list[tuple]) -> Iterator[pd.DataFrame]:
        at, moves, errors, done = self.session.get() if self.session.exists() else (0, 0, 0, -1)
        opened = {s for (s,) in self.opened.get()} if self.opened.exists() else set()
        for _, seq, n_steps, tool, direction, step in sorted(events, key=lambda e: e[1]):
            if seq <= done or tool not in (C.MOVE, C.OPEN):
                continue
            done = seq
            if tool == C.OPEN:
                opened.add(at + 1)
            elif (to := C.moved(at, n_steps, direction, step)) is None:
                errors += 1
            else:
                at, moves = to, moves + 1
        self.session.update((at, moves, errors, done))
        if opened:
            self.opened.put([(s,) for s in sorted(opened)])
        yield pd.DataFrame({"order_id": [key[0]], "at_step": [at + 1], "n_moves": [moves], "n_errors": [errors], "opened": [sorted(opened)]})


class Siblings(Held):
    columns, schema = ["order_id", "classification", "tag"], "at long, order_id long, classification string, tag string"

    def init(self, handle) -> None:
        super().init(handle)
        self.known = handle.getValueState("known", "order_id long, classification string, tag string")

    def take(self, key, events: list[tuple]) -> Iterator[pd.DataFrame]:
        known, out = tuple(self.known.get()) if self.known.exists() else None, []
        for case in sorted(events, key=lambda e: e[:2]):
            known, (derived, answer) = C.answered(known, case[1:])
            out.append((case[1], key[0], derived, answer))
        if known:
            self.known.update(known)
        made = pd.DataFrame(out, columns=["order_id", "fingerprint", "derived_from", "classification"])
        yield made.assign(derived_from=made["derived_from"].astype("Int64"))


def running_cursors(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """SESSIONS of a stream of MOVES, each time a session's events are due. Times of a session rise with seq; one repeated counts once."""
    return events.withWatermark("ts", late).groupBy("order_id").transformWithStateInPandas(Cursor(), SESSIONS, "Update", "EventTime")


def running_answers(cases: DataFrame, late: str = "1 hour") -> DataFrame:
    """The answer of each case of a stream of CASES, once it is due; in order of (ts, order_id) of its fingerprint."""
    return cases.withWatermark("ts", late).groupBy("fingerprint").transformWithStateInPandas(Siblings(), C.ANSWERS, "Update", "EventTime")
