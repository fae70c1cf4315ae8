from datetime import datetime, timedelta

from boundwright.streaming.sessions import SCHEMA, running_evidence


def test_running_evidence(spark, tmp_path):
    start = datetime(2026, 1, 1)
    events = [(1, 1, "inspect", "low"), (1, 2, "run_simulation", "high"), (1, 2, "run_simulation", "high"), (2, 1, "inspect", None), (1, 3, "inspect", None)]
    rows = [(*e, start + timedelta(minutes=i)) for i, e in enumerate(events)]
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    job = running_evidence(stream).writeStream.outputMode("complete").format("memory").queryName("evidence").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = {r.order_id: (r.n_calls, r.simulated, r.confidence_so_far) for r in spark.table("evidence").collect()}
    assert got == {1: (3, True, "high"), 2: (1, False, None)}
