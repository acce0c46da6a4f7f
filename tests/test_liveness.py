"""Timers: rows of keys that are silent, over restarts too."""

import os
import time

import pytest
from pyspark.sql import functions as F

from millrace.streaming import liveness
from millrace.streaming.run import available_rows, file_stream

SMALL = "/root/testdata/sf0.001"
UPDATES = "run string, phase string, completed_steps long, total_steps long, detail string, status string, n long"


def run_until(spark, folder, reached, seconds=90, **settings):
    """The heartbeats of what lies in the folder on processing time, until the rows so far say that it is reached; all rows so far."""
    source = spark.readStream.schema(UPDATES).json(f"{folder}/in")
    rows = liveness.heartbeats(source, "run", order="n", **settings)
    told = spark.read.parquet(f"{folder}/out").collect() if os.path.isdir(f"{folder}/out") else []

    def keep(batch, number):
        batch = batch.coalesce(1).persist()
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        told.extend(batch.collect())
        batch.unpersist()

    with liveness.rocksdb_state(spark):
        query = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(processingTime="500 milliseconds").start()
    end = time.time() + seconds
    while time.time() < end and query.isActive and not reached(told):
        time.sleep(0.2)
    query.stop()
    assert query.exception() is None
    return spark.read.parquet(f"{folder}/out").orderBy("at", "batch").collect()


def test_a_silent_key_speaks_without_events_and_after_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    first = [("a", "load", None, None, None, None, 1), ("a", "train", 0, 100, "epoch 1", None, 2), ("b", "train", 5, 10, None, None, 3), ("b", "train", 10, 10, "done", "completed", 4), ("b", "late", 11, 10, None, None, 5)]
    spark.createDataFrame(first, UPDATES).coalesce(1).write.json(f"{folder}/in")
    settings = dict(interval_seconds=1.0, stall_seconds=8.0, forget_seconds=600.0)
    warned = lambda n: lambda rows: sum(x["status"] == "warning_possible_stall" for x in rows) >= n
    rows = run_until(spark, folder, warned(2), **settings)
    a = [x for x in rows if x["run"] == "a"]
    assert [x["reason"] for x in a[:2]] == ["started", "phase"] and len(a) > 3 and all(x["reason"] == "heartbeat" for x in a[2:])
    assert all((x["status"] == "warning_possible_stall") == (x["seconds_since_progress"] >= 8) for x in a[2:]) and a[-1]["status"] == "warning_possible_stall"
    assert all((x["phase"], x["completed_steps"], x["percent"], x["detail"]) == ("train", 0, 0.0, "epoch 1") for x in a[1:])
    b = [x for x in rows if x["run"] == "b"]
    assert [(x["reason"], x["status"]) for x in b] == [("started", "running"), ("ended", "completed")] and b[-1]["percent"] == 100.0
    more = run_until(spark, folder, lambda told: len(told) > len(rows), **settings)
    silent = more[len(rows) :]
    assert silent and {(x["run"], x["reason"], x["status"]) for x in silent} == {("a", "heartbeat", "warning_possible_stall")}
    # an update after the restart: steps since the phase began, and running again
    spark.createDataFrame([("a", "train", 40, 100, None, None, 6)], UPDATES).coalesce(1).write.mode("append").json(f"{folder}/in")
    last = run_until(spark, folder, lambda rows: any(x["completed_steps"] == 40 for x in rows), **settings)[len(more) :]
    assert {x["run"] for x in last} == {"a"}
    steady = [x for x in last if x["completed_steps"] == 40]
    assert steady and steady[0]["steps_per_second"] > 0 and steady[0]["eta_seconds"] > 0 and steady[0]["percent"] == 40.0


def test_a_key_is_forgotten(spark, tmp_path):
    spark.createDataFrame([("a", None, None, None, None, None, 1)], UPDATES).coalesce(1).write.json(f"{tmp_path}/in")
    rows = run_until(spark, str(tmp_path), lambda rows: rows and rows[-1]["seconds_since_progress"] >= 3, seconds=40, interval_seconds=1.0, stall_seconds=1.0, forget_seconds=3.0)
    rows += run_until(spark, str(tmp_path), lambda told: len(told) > len(rows), seconds=15, interval_seconds=1.0, stall_seconds=1.0, forget_seconds=3.0)[len(rows) :]
    assert rows[0]["reason"] == "started" and rows[0]["phase"] == ""
    quiet = [x["seconds_since_progress"] for x in rows[1:]]
    assert quiet and sum(s >= 3 for s in quiet) <= 1  # one at most when the time is up, and none after it


def test_settings_must_be_positive(spark):
    events = spark.createDataFrame([], "run string, ts timestamp")
    with pytest.raises(ValueError, match="positive"):
        liveness.silences(events, "run", "ts", 0)
    with pytest.raises(ValueError, match="positive"):
        liveness.heartbeats(events, "run", interval_seconds=0)


def plain_silences(rows, stall, late):
    """(key, since) in seconds, by a look at all events."""
    by, top = {}, max(t for _, t in rows if t is not None)
    for k, t in rows:
        if t is not None:
            by.setdefault(k, set()).add(t)
    out = set()
    for k, times in by.items():
        order = sorted(times)
        out |= {(k, a) for a, b in zip(order, order[1:], strict=False) if b - a >= stall}
        if order[-1] + stall <= top - late:
            out.add((k, order[-1]))
    return out


def test_silences_in_one_run_and_in_many_batches(spark, tmp_path):
    rows = [("a", 0), ("a", 10), ("a", 500), ("b", 400), ("c", 20), ("c", 20), ("d", 1000), (None, 30), ("b", None), ("e", 700)]
    schema = "k string, t long"
    wanted = plain_silences(rows, 100, 60)
    every = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t"))
    every.coalesce(1).write.parquet(f"{tmp_path}/one/in")
    steps = [every.filter("t < 100"), every.filter("t >= 100 and t < 600 or t is null"), every.filter("t >= 600")]
    found = []
    with liveness.rocksdb_state(spark):
        source = file_stream(spark, f"{tmp_path}/one/in")
        found.append(available_rows(liveness.silences(source, "k", "ts", 100, "60 seconds"), f"file://{tmp_path}/one/run"))
        for k, some in enumerate(steps):
            some.coalesce(1).write.parquet(f"{tmp_path}/many/in/step={k}")
            source = spark.readStream.schema(every.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/many/in")
            found_now = available_rows(liveness.silences(source, "k", "ts", 100, "60 seconds"), f"file://{tmp_path}/many/run")
        found.append(found_now)
    for df in found:
        got = [(x["k"], x["s"]) for x in df.select("k", F.unix_seconds("since").alias("s")).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
