"""The sink over failures: a run killed between steps, torn folders, and a batch that runs twice."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from boundwright.streaming import sink as K

SCHEMA = "order_id long, verdict string, error string"


def test_killed_between_steps(spark, tmp_path):
    path, todo, calls = str(tmp_path / "out"), spark.range(100).toDF("order_id"), []

    def work(rows):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return rows.withColumns({"verdict": F.lit("true"), "error": F.when(F.col("order_id") % 10 == 0, "busy")})

    assert K.results(spark, path, SCHEMA).count() == 0
    with pytest.raises(RuntimeError):
        K.stepwise(todo, work, path, "order_id", 4)
    assert K.finished(spark, path) == [0, 1]
    # A torn folder: part of a file, no marker.
    os.makedirs(f"{path}/step=2")
    with open(f"{path}/step=2/part-0.parquet", "wb") as f:
        f.write(b"PAR1 torn")
    first = K.results(spark, path, SCHEMA).count()
    assert K.stepwise(todo, work, path, "order_id", 4) == [2, 3]
    assert first < 100 and K.results(spark, path, SCHEMA).select("order_id").distinct().count() == K.results(spark, path, SCHEMA).count() == 100
    assert K.stepwise(todo, work, path, "order_id", 4) == []
    left = K.remaining(todo, K.results(spark, path, SCHEMA), "order_id")
    assert sorted(r.order_id for r in left.collect()) == list(range(0, 100, 10))
    K.put(left.withColumns({"verdict": F.lit("false"), "error": F.lit(None).cast("string")}), path, 4)
    done = K.results(spark, path, SCHEMA)
    assert K.remaining(todo, done, "order_id").count() == 0
    assert {r.order_id: r.verdict for r in K.latest(done, "order_id").collect()} == {i: "true" if i % 10 else "false" for i in range(100)}


def test_batch_runs_twice(spark, tmp_path):
    path, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        stream = spark.readStream.schema("order_id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        K.streamed(stream.withColumns({"verdict": F.lit("true"), "error": F.lit(None).cast("string")}), path, state).awaitTermination(120)

    for k in range(2):
        spark.range(10 * k, 10 * k + 10).toDF("order_id").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        go()
    # As if the run had died before the last batch was committed: it is in the offsets, not in the commits.
    last = max(int(x) for x in os.listdir(f"{state}/commits") if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{state}/commits/{name}"):
            os.remove(f"{state}/commits/{name}")
    shutil.rmtree(f"{path}/step={last}")
    go()
    go()
    assert sorted(r.order_id for r in K.results(spark, path, SCHEMA).collect()) == list(range(20))
