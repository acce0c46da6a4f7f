"""Structured Streaming counterparts of operators/progress.py: windows with watermarks, keyed pauses and stalls, logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windows(events: DataFrame, ts: str, by: str, value: str, optional: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Telemetry by window and group; a window is final when the watermark has passed it. ts must be a timestamp."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, size), by)
    rows = grouped.agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), F.max(optional).alias("max_optional"), F.avg(optional).alias("mean_optional"), F.count(optional).alias("n_optional"))
    return rows.select(F.col("window.start").alias("start"), by, "n", "max_value", "mean_value", "max_optional", "mean_optional", "n_optional")


def hysteresis(events: DataFrame, by: str, ts: str, order: str, value: str, limit: float, resume: float, buckets: int = 512) -> DataFrame:
    """Ended pauses as they end. A group's state is whether it is paused, the pause's number and its start.

    Groups share a state row by a hash of their key, as a call for each would cost more than its events; a checkpoint holds for one number of buckets.
    Values that can't begin or end a pause aren't shuffled.
    """
    kind = dict(events.dtypes)[by]
    last = 9_223_372_036_854_775  # where a row without a time is put

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {g: (p, n, s) for g, p, n, s in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        rows = pd.concat(list(frames)).sort_values(["_at", "_order"])
        for g, at, v in zip(rows["_key"].tolist(), rows["_at"].tolist(), rows["_value"].tolist(), strict=True):
            paused, number, start = known.get(g, (False, 0, 0))
            if not paused and v >= limit:
                known[g] = True, number + 1, at
            elif paused and v <= resume:
                known[g] = False, number, start
                out.append((g, number, start, at))
        state.update(tuple(map(list, zip(*[(g, *s) for g, s in known.items()], strict=True))) if known else ([], [], [], []))
        yield pd.DataFrame(out, columns=["_key", "episode", "_start", "_end"])

    signals = events.filter((F.col(value) >= limit) | (F.col(value) <= resume))
    text = F.col(by).cast("string")
    rows = signals.select(F.pmod(F.xxhash64(by), F.lit(buckets)).alias("_bucket"), text.alias("_key"), F.coalesce(F.unix_micros(ts), F.lit(last)).alias("_at"), F.col(order).alias("_order"), F.col(value).alias("_value"))
    found = rows.groupBy("_bucket").applyInPandasWithState(follow, "_key string, episode long, _start long, _end long", "keys array<string>, paused array<boolean>, number array<long>, start array<long>", "append", GroupStateTimeout.NoTimeout)
    seconds = (F.col("_end") - F.col("_start")) / 1e6
    return found.select(F.col("_key").cast(kind).alias(by), "episode", F.timestamp_micros("_start").alias("start_ts"), F.timestamp_micros("_end").alias("end_ts"), seconds.alias("seconds"))


def stalls(events: DataFrame, by: str, ts: str, order: str, stall_seconds: float, late: str = "1 hour") -> DataFrame:
    """Gaps of stall_seconds or more: when the next event comes, or, as open ones, when the watermark shows that none came."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            (last,) = state.get
            out.append((key[0], pd.Timestamp(last * 1000), None, True))
        else:
            last = state.get[0] if state.exists else None
            for at in pd.concat(list(frames)).sort_values([ts, order])[ts]:
                now = int(at.value // 1000)
                if last is not None and (now - last) / 1e6 >= stall_seconds:
                    out.append((key[0], pd.Timestamp(last * 1000), (now - last) / 1e6, False))
                last = now
            state.update((last,))
            due = last // 1000 + int(stall_seconds * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, "since", "seconds", "open"])

    kind = dict(events.dtypes)[by]
    return events.withWatermark(ts, late).groupBy(by).applyInPandasWithState(follow, f"{by} {kind}, since timestamp, seconds double, open boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def log(stream: DataFrame, path: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Appends all that is there to JSON lines, each row once over any restarts, and ends."""
    writer = stream.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start(path)


class ProgressLog(StreamingQueryListener):
    """Keeps a short row of each micro-batch's progress."""

    def __init__(self, most: int = 1000):
        self.rows: list[dict] = []
        self.most = most

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rows = [*self.rows[-self.most + 1 :], {"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond}]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
