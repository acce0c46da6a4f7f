"""Progress that is told while nothing comes: keyed state with registered timers, so that a silent key speaks without a new event.

`heartbeats` runs on processing time: every key that has started and not ended gives a row at each interval, with what its last update said and a warning once the silence
is long. `silences` runs on event time: a row for each stretch without events, as soon as the watermark shows it, each once. State lies in RocksDB with the query's checkpoint, timers
with it, so both go on after a restart. A key's state is one small row and one timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: What ends a key's progress.
TERMINAL = ("completed", "failed", "cancelled")
_STATE = "started long, progressed long, phase_started long, phase_first long, phase string, completed long, total long, detail string, status string, timer long"
_SNAPSHOT = "reason string, at timestamp, phase string, status string, completed_steps long, total_steps long, percent double, steps_per_second double, eta_seconds double, elapsed_seconds double, seconds_since_progress double, detail string"
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers need; the session's own settings come back."""
    old = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _time(ms: float) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC)


class Heartbeats(StatefulProcessor):
    """One key's progress: what was said last, and a timer for when it is due to speak again."""

    def __init__(self, by: str, interval_ms: int, stall_ms: int, forget_ms: int):
        self.by, self.interval_ms, self.stall_ms, self.forget_ms = by, interval_ms, stall_ms, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        # a key that has been forgotten by its program goes from the state, and is new when it comes again
        self.state = handle.getValueState("progress", _STATE, self.forget_ms)

    def _row(self, key: tuple, s: dict, now: int, reason: str) -> Row:
        steps = s["completed"] - s["phase_first"] if s["completed"] is not None and s["phase_first"] is not None else None
        phase_ms = now - s["phase_started"]
        speed = steps * 1000 / phase_ms if steps is not None and steps > 0 and phase_ms > 0 else None
        known = s["completed"] is not None and s["total"] is not None
        eta = (s["total"] - s["completed"]) / speed if known and speed is not None and s["total"] >= s["completed"] else None
        percent = 100 * s["completed"] / s["total"] if known and s["total"] > 0 else None
        status = s["status"] or ("warning_possible_stall" if now - s["progressed"] >= self.stall_ms else "running")
        told = {"reason": reason, "at": _time(now), "phase": s["phase"], "status": status, "completed_steps": s["completed"], "total_steps": s["total"], "percent": percent, "steps_per_second": speed, "eta_seconds": eta, "elapsed_seconds": (now - s["started"]) / 1000, "seconds_since_progress": (now - s["progressed"]) / 1000, "detail": s["detail"]}
        return Row(**{self.by: key[0]}, **told)

    def _due(self, s: dict, at: int | None) -> None:
        """One timer at most; none once a key has ended."""
        if s["timer"] is not None:
            self.handle.deleteTimer(s["timer"])
        s["timer"] = at
        if at is not None:
            self.handle.registerTimer(at)

    def _put(self, s: dict) -> None:
        self.state.update(tuple(s.values()))

    def _get(self) -> dict | None:
        names = [part.split()[0] for part in _STATE.split(", ")]
        return dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else None

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        s = self._get()
        for r in sorted(rows, key=lambda r: (r["_order"] is not None, r["_order"] or 0)):
            if s is not None and s["status"]:
                continue  # it has ended: what comes late changes nothing
            fresh = s is None
            if fresh:
                s = {"started": now, "progressed": now, "phase_started": now, "phase_first": r["completed_steps"], "phase": r["phase"], "completed": None, "total": None, "detail": None, "status": None, "timer": None}
            changed = r["phase"] != s["phase"]
            if changed:
                s["phase_started"], s["phase_first"] = now, r["completed_steps"]
            elif s["phase_first"] is None:
                s["phase_first"] = r["completed_steps"]
            s |= {"phase": r["phase"], "completed": r["completed_steps"], "total": r["total_steps"], "detail": r["detail"], "progressed": now, "status": r["status"] if r["status"] in TERMINAL else None}
            if fresh or changed or s["status"]:
                yield self._row(key, s, now, "ended" if s["status"] else "started" if fresh else "phase")
        if s is not None:
            if s["status"] or s["timer"] is None:  # updates don't move a heartbeat that is due
                self._due(s, None if s["status"] else now + self.interval_ms)
            self._put(s)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        s = self._get()
        if s is not None and not s["status"]:
            yield self._row(key, s, now, "heartbeat")
            s["timer"] = None  # it has just fired
            if now - s["progressed"] < self.forget_ms:
                self._due(s, now + self.interval_ms)
            progressed = s["progressed"]
            self._put(s)
            if now - progressed >= self.forget_ms:
                self.state.clear()

    def close(self) -> None:
        pass


def heartbeats(updates: DataFrame, by: str, interval_seconds: float = 5.0, stall_seconds: float = 60.0, forget_seconds: float = 86_400.0, order: str | None = None) -> DataFrame:
    """Snapshots of every key's progress: when it starts, changes its phase or ends, and at each interval between, whether anything came or not.

    updates: by, phase, completed_steps, total_steps, detail, status (completed, failed or cancelled to end; else null); order tells rows of one micro-batch apart. A key of which
    nothing is heard for forget_seconds is forgotten. A null phase counts as empty. Run it with a processing-time trigger, at most an interval long, in `rocksdb_state`, update mode.
    """
    if interval_seconds <= 0 or stall_seconds <= 0 or forget_seconds <= 0:
        raise ValueError("intervals must be positive")
    own = {"phase": F.coalesce(F.col("phase"), F.lit("")), "completed_steps": F.col("completed_steps").cast("long"), "total_steps": F.col("total_steps").cast("long"), "detail": F.col("detail").cast("string"), "status": F.col("status").cast("string"), "_order": (F.col(order) if order else F.lit(None)).cast("long")}
    kind = updates.schema[by].dataType.simpleString()
    rows = updates.select(by, *[v.alias(k) for k, v in own.items()])
    worker = Heartbeats(by, round(interval_seconds * 1000), round(stall_seconds * 1000), round(forget_seconds * 1000))
    return rows.groupBy(by).transformWithState(worker, f"`{by}` {kind}, {_SNAPSHOT}", "Update", "ProcessingTime")


class Silences(StatefulProcessor):
    """The latest event of a key, and a timer for the time by which the next one is due."""

    def __init__(self, by: str, stall_us: int):
        self.by, self.stall_us = by, stall_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "us long, timer long, told boolean")

    def _due(self, us: int) -> int:
        """The first whole millisecond by which the silence is long enough."""
        return -(-(us + self.stall_us) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, timer, told = self.state.get() if self.state.exists() else (None, None, False)
        for us in sorted(r["_us"] for r in rows if r["_us"] is not None):
            if last is not None and us <= last:
                continue
            if last is not None and us - last >= self.stall_us and not told:
                yield Row(**{self.by: key[0]}, since_us=last)
            last, told = us, False
        if last is None:
            return
        due = None if told else max(self._due(last), timerValues.getCurrentWatermarkInMs() + 1)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        self.state.update((last, due, told))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            last, timer, told = self.state.get()
            if not told and expiredTimerInfo.getExpiryTimeInMs() == timer:
                yield Row(**{self.by: key[0]}, since_us=last)
                self.state.update((last, None, True))

    def close(self) -> None:
        pass


def silences(events: DataFrame, by: str, ts: str, stall_seconds: float, late: str = "1 hour") -> DataFrame:
    """by and since (the last event before it) of every stretch of stall_seconds or more without events: those that a later event ended, and those that the watermark has passed, with no event at all.

    Each stretch comes once, in append mode; rows without a time are left out, and a row that comes late, before its key's latest, changes nothing.
    """
    if stall_seconds <= 0:
        raise ValueError("stall_seconds must be positive")
    kind = events.schema[by].dataType.simpleString()
    rows = events.withWatermark(ts, late).select(by, ts, F.unix_micros(F.col(ts)).alias("_us"))
    found = rows.groupBy(by).transformWithState(Silences(by, round(stall_seconds * 1e6)), f"`{by}` {kind}, since_us long", "Append", "EventTime")
    return found.select(by, F.timestamp_micros("since_us").alias("since"))
