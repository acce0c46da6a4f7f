"""Device telemetry as a stream: a Python data source whose offsets count polls.

A reading can't be taken twice, so the source keeps a journal below a folder that survives the driver: each poll's rows are written and renamed into place before its number is given out as
an offset. A restarted query reads what its checkpoint hasn't committed from the journal, row for row, and goes on from there; polls that are committed leave it, but for the last, whose number
the next one follows. A command that fails, takes too long or says something else than a reading gives a row with its error, so that failures are counted and never stop a run.

Readings are polled where the source's driver side runs, one thread to a device, each within its time; tasks get them as their partitions, some devices to each.
"""

from __future__ import annotations

import json
import os
import posixpath
import shlex
import subprocess
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "device string, poll long, at timestamp, temperature_c double, utilization_percent double, memory_used_mib double, power_w double, error string"
#: Devices of one task.
DEVICES_A_TASK = 256


def reading(line: str) -> tuple[float, float, float, float | None]:
    """Temperature, utilization, memory and power of a line; a power of [N/A] is none. Anything else is an error."""
    values = [v.strip() for v in line.strip().split(",")]
    if len(values) != 4:
        raise ValueError(f"four values are expected: {line.strip()[:80]!r}")
    first = [float(v) for v in values[:3]]
    return (*first, None if values[3] == "[N/A]" else float(values[3]))


def poll(device: str, command: str, seconds: float) -> dict:
    """One reading of a device, or its error, with its time."""
    row = {"device": device, "at": time.time(), "values": None, "error": None}
    try:
        done = subprocess.run(shlex.split(command), capture_output=True, text=True, timeout=seconds, check=True)
        row["values"] = reading(done.stdout)
    except (OSError, ValueError, subprocess.SubprocessError) as error:
        row["error"] = f"{type(error).__name__}: {str(error)[:200]}"
    return row


class Journal:
    """Polls that are taken and not yet let go, one file each; a folder of any file system that pyarrow knows."""

    def __init__(self, uri: str):
        self.files, self.folder = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.folder, recursive=True)

    def numbers(self) -> list[int]:
        found = self.files.get_file_info(fs.FileSelector(self.folder))
        return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))

    def put(self, number: int, rows: list[dict]) -> None:
        new = posixpath.join(self.folder, f"{number:012d}.new")
        with self.files.open_output_stream(new) as out:
            out.write(json.dumps(rows).encode())
        self.files.move(new, posixpath.join(self.folder, f"{number:012d}.json"))

    def get(self, number: int) -> list[dict]:
        with self.files.open_input_stream(posixpath.join(self.folder, f"{number:012d}.json")) as source:
            return json.loads(source.read())

    def let_go(self, below: int) -> None:
        for number in self.numbers()[:-1]:
            if number <= below:
                self.files.delete_file(posixpath.join(self.folder, f"{number:012d}.json"))


class Rows(InputPartition):
    """Some devices' rows of one poll."""

    def __init__(self, number: int, rows: list[dict]):
        super().__init__(number)
        self.number, self.rows = number, rows


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.devices = json.loads(options["devices"])
        self.journal = Journal(options["journal"])
        self.interval, self.timeout = float(options.get("interval", 1.0)), float(options.get("timeout", 10.0))
        if not self.devices or self.interval <= 0 or self.timeout <= 0:
            raise ValueError("devices must be named, interval and timeout positive")
        self.last = 0.0

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        number = max(self.journal.numbers(), default=0)
        if time.monotonic() - self.last >= self.interval or not self.last:
            with ThreadPoolExecutor(min(len(self.devices), 32)) as threads:
                rows = list(threads.map(lambda d: poll(d, self.devices[d], self.timeout), sorted(self.devices)))
            number += 1
            self.journal.put(number, rows)
            self.last = time.monotonic()
        return {"poll": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for number in range(start["poll"] + 1, end["poll"] + 1):
            rows = self.journal.get(number)
            out += [Rows(number, rows[k : k + DEVICES_A_TASK]) for k in range(0, len(rows), DEVICES_A_TASK)]
        return out

    def read(self, partition: Rows) -> Iterator[tuple]:
        for r in partition.rows:
            values = r["values"] or [None] * 4
            yield (r["device"], partition.number, datetime.fromtimestamp(r["at"], UTC), *values, r["error"])

    def commit(self, end: dict) -> None:
        self.journal.let_go(end["poll"])


class DevicePolls(DataSource):
    """Format device_polls. Options: devices (JSON: name -> command), journal (a folder), interval and timeout (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "device_polls"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PollReader(self.options)


def device_stream(spark: SparkSession, devices: dict[str, str], journal: str, interval: float = 1.0, timeout: float = 10.0) -> DataFrame:
    """Readings of all devices (name -> command) at each interval, as a stream. The journal's folder must survive the driver, like the query's checkpoint, and serve one query."""
    spark.dataSource.register(DevicePolls)
    if "://" not in journal:
        journal = "file://" + os.path.abspath(journal)
    reader = spark.readStream.format("device_polls").option("devices", json.dumps(devices)).option("journal", journal)
    return reader.option("interval", interval).option("timeout", timeout).load()


def summary(polls: DataFrame, by: str = "device") -> DataFrame:
    """Each device's readings and errors: numbers, maxima and means; power where it is told. Rows of a stream or a table."""
    kept = ("temperature_c", "utilization_percent", "memory_used_mib", "power_w")
    most = [f(c).alias(f"{n}_{c}") for c in kept for n, f in (("max", F.max), ("mean", F.avg))]
    return polls.groupBy(by).agg(F.count(F.lit(1)).alias("polls"), F.count("temperature_c").alias("samples"), F.count("error").alias("query_errors"), *most)
