"""Streaming forms on small files, one file a micro-batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from callweave.functions import vocab as V
from callweave.streaming import flows

T0 = datetime(2024, 1, 1)


def streamed(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/in/*")


def test_waits_time_out(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[(1, at(0), False), (2, at(0), False)], [(2, at(5), True)], [(3, at(90), False)], [(4, at(91), True)]]
    stream = streamed(spark, tmp_path, batches, "call_id long, at timestamp, ready boolean")
    got = {(r.call_id, r.state) for r in flows.drain(flows.waits(stream, 30), "waits").collect()}
    assert got == {(1, "held"), (2, "ready"), (4, "ready")}


def test_states_span_batches(spark, tmp_path):
    steps = [(1, i, s, "continue") for i, s in enumerate(V.STAGES)]
    stream = streamed(spark, tmp_path, [steps[:4], [(1, 2, V.STAGES[2], "continue")], steps[4:] + [(2, 50, V.STAGES[0], "drop"), (2, 51, V.STAGES[1], "continue")]], "call_id long, seq long, stage string, action string")
    rows = flows.drain(flows.call_states(stream), "states").groupBy("call_id").agg(F.max_by("status", "seq").alias("s"), F.count("*").alias("n")).collect()
    assert {(r.call_id, r.s, r.n) for r in rows} == {(1, "completed", 9), (2, "skipped", 1)}


def test_dedup_within_ttl(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    stream = streamed(spark, tmp_path, [[(1, "a", at(0)), (2, "a", at(1))], [(3, "a", at(40)), (4, "b", at(41))], [(5, "a", at(80))]], "id long, key string, at timestamp")
    assert sorted(r.id for r in flows.drain(flows.deduplicated(stream, ["key"]).select("id"), "dedup").collect())[0] == 1
