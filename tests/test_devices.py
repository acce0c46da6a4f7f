"""The telemetry source: offsets, journal, errors, restarts."""

import json
import sys
import time

import pytest

from millrace.sources import devices

#: A device that counts its polls, and fails at every third.
COUNTER = """import os, sys
p = sys.argv[1]; n = os.path.getsize(p) + 1 if os.path.exists(p) else 1
open(p, "a").write("x")
sys.exit(3) if n % 3 == 0 else print(f"{n}, 50, 2048, " + ("[N/A]" if n % 2 else "77.5"))
"""


@pytest.fixture
def counter(tmp_path):
    (tmp_path / "device.py").write_text(COUNTER)
    return f"{sys.executable} {tmp_path}/device.py {tmp_path}/polled"


def run(spark, tmp_path, named, enough, fail=False):
    """A query over the source until it has told enough rows; with fail, its sink breaks in the second batch. All rows so far."""
    stream = devices.device_stream(spark, named, f"{tmp_path}/journal", interval=0.2)
    told = []

    def sink(batch, number):
        if fail and number >= 1:
            raise RuntimeError("the sink is broken")
        rows = batch.collect()
        spark.createDataFrame(rows, batch.schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        told.extend(rows)

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="200 milliseconds").start()
    end = time.time() + 60
    while time.time() < end and query.isActive and len(told) < enough:
        time.sleep(0.2)
    query.stop()
    assert (query.exception() is not None) == fail
    return sorted((r.asDict() for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda r: (r["poll"], r["device"]))


def test_polls_are_numbered_counted_and_come_once_over_restarts(spark, tmp_path, counter):
    named = {"gpu0": counter, "gone": "/no/such/command", "odd": "echo 1, 2"}
    run(spark, tmp_path, named, 99, fail=True)  # breaks off with a batch that is planned and not done
    first = run(spark, tmp_path, named, 9)
    rows = run(spark, tmp_path, named, 6)
    assert rows[: len(first)] == first  # what was committed comes once, as it was
    polls = sorted({r["poll"] for r in rows})
    assert polls == list(range(1, len(polls) + 1)) and len(rows) == 3 * len(polls)
    own = [r for r in rows if r["device"] == "gpu0"]
    assert [r["poll"] for r in own] == polls
    told = [r["temperature_c"] for r in own if r["error"] is None]
    assert told == sorted(set(told)) and all(n % 3 for n in told)  # no reading twice; one that a stop broke off has no number
    assert all((r["temperature_c"] is None) == (r["error"] is not None) and r["power_w"] == (None if r["error"] or r["temperature_c"] % 2 else 77.5) for r in own)
    assert all(r["error"].startswith("FileNotFoundError") for r in rows if r["device"] == "gone")
    assert all("four values" in r["error"] for r in rows if r["device"] == "odd")
    found = {r["device"]: r for r in devices.summary(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert all(r["polls"] == len(polls) == r["samples"] + r["query_errors"] for r in found.values())
    assert found["gpu0"]["query_errors"] == len(polls) - len(told) > 0 and found["gone"]["samples"] == 0 and found["gpu0"]["max_temperature_c"] == told[-1]
    left = devices.Journal(f"file://{tmp_path}/journal").numbers()
    assert len(left) < len(polls) and left[-1] >= polls[-1]  # committed polls have left the journal


def test_a_poll_that_was_not_written_whole_is_none(tmp_path):
    journal = devices.Journal(f"file://{tmp_path}/j")
    journal.put(4, [{"device": "a"}])
    (tmp_path / "j" / "000000000005.new").write_text("[{")
    assert journal.numbers() == [4] and journal.get(4) == [{"device": "a"}]
    journal.put(5, [])
    journal.let_go(5)
    assert journal.numbers() == [5]  # the last stays, as the next follows it


def test_reading():
    assert devices.reading(" 61, 98,2048 , [N/A]\n") == (61.0, 98.0, 2048.0, None)
    for odd in ("", "1, 2, 3", "1, 2, x, 4", "1, 2, 3, 4, 5"):
        with pytest.raises(ValueError):
            devices.reading(odd)


def test_options(tmp_path):
    options = {"devices": json.dumps({"a": "echo"}), "journal": f"file://{tmp_path}/j"}
    assert devices.PollReader(options).initialOffset() == {"poll": 0}
    for odd in ({"devices": "{}"}, {"interval": "0"}, {"timeout": "-1"}):
        with pytest.raises(ValueError):
            devices.PollReader(options | odd)


def test_devices_are_dealt_to_tasks(tmp_path):
    named = {f"d{k:03d}": "echo 1, 2, 3, 4" for k in range(devices.DEVICES_A_TASK + 10)}
    reader = devices.PollReader({"devices": json.dumps(dict.fromkeys(named, "true")), "journal": f"file://{tmp_path}/j"})
    reader.journal.put(1, [{"device": d, "at": 0.0, "values": [1.0, 2.0, 3.0, None], "error": None} for d in sorted(named)])
    parts = reader.partitions({"poll": 0}, {"poll": 1})
    assert [len(p.rows) for p in parts] == [devices.DEVICES_A_TASK, 10]
    assert sorted(r[0] for p in parts for r in reader.read(p)) == sorted(named)
    assert reader.partitions({"poll": 1}, {"poll": 1}) == []
