"""Keyed state over streams equals the batch folds, whatever the order of arrival, and over restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boundwright.operators import cursors as C
from boundwright.sources.projections import view
from boundwright.streaming import state as S

START = datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def streamed(spark, tmp_path, rows, schema, running):
    """Everything the stream gives, one start a file of rows; the last file moves the watermark past all of them."""
    out = []
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
        keep = lambda batch, _: out.extend(batch.collect())
        job = running(stream, "1 hour").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        job.awaitTermination(120)
    return out


def cut(rng, rows, n):
    rows = list(rows)
    rng.shuffle(rows)
    return [rows[i::n] for i in range(n)]


def test_cursor(rocks, sf_dir, tmp_path):
    rng = random.Random(2)
    events = view(rocks, sf_dir, "session_events").filter("order_id < 12")
    rows = [(r.order_id, r.seq, r.n_steps, r.tool, r.direction, r.step, START + timedelta(minutes=r.seq)) for r in events.collect()]
    parts = cut(rng, rows + rows[:5], 3)
    end = [(-1, 0, 1, "move_window", "next", None, START + timedelta(days=1))]
    got = streamed(rocks, tmp_path, [*parts, end], S.MOVES, S.running_cursors)
    last = {r.order_id: tuple(r) for r in got if r.order_id >= 0}
    assert last == {r.order_id: tuple(r) for r in C.cursors(events).collect()}
    assert any(r[4] for r in last.values()) and any(r[3] for r in last.values())


def test_siblings(rocks, sf_dir, tmp_path):
    rng = random.Random(4)
    cases = view(rocks, sf_dir, "sibling_cases").filter("order_id % 3 = 0").withColumn("fingerprint", F.split("fingerprint", "-")[0])
    rows = [(r.order_id, r.fingerprint, r.classification, r.tag, START + timedelta(seconds=r.finished % 3000)) for r in cases.collect()]
    end = [(-1, "end", "true", "", START + timedelta(days=1))]
    got = streamed(rocks, tmp_path, [*cut(rng, rows, 3), end], S.CASES, S.running_answers)
    batch = C.answers(cases.withColumn("finished", F.col("finished") % 3000))
    want = {r.order_id: tuple(r) for r in batch.collect()}
    assert {r.order_id: tuple(r) for r in got if r.order_id >= 0} == want
    assert len([r for r in got if r.order_id >= 0]) == len(want) and any(r[2] for r in want.values())


def test_moves():
    assert [C.moved(1, 3, d, s) for d, s in (("next", 0), (" Back ", None), ("up", 0), (None, -5), ("", 9), ("up", 2))] == [2, 0, None, 0, 2, 1]


def test_answers():
    know = (1, "true", "A")
    assert C.answered(None, (2, "false", "")) == ((2, "false", ""), (None, "false"))
    assert C.answered(know, (2, "false", "")) == (know, (1, "true"))
    assert C.answered(know, (2, "false", "B")) == ((2, "false", "B"), (None, "false"))
    assert C.answered((1, "False", "A"), (2, "true", "A"))[1] == (None, "true")
    assert C.answered(know, (1, "review", ""))[1] == (None, "review")
