"""Queries over the event table: progress, stalls, hysteresis, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import progress
from millrace.plans.registry import ORACLES, register
from millrace.sources.tables import load

_STALL, _TOTAL = 6 * 3600, 400


def events(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("double")).withColumn("k", F.when(F.col("k") % 5 != 0, F.col("k")))


_EVENTS = "ev AS (SELECT *, CASE WHEN (props->>'$.k')::DOUBLE % 5 <> 0 THEN (props->>'$.k')::DOUBLE END AS k FROM events)"
_SECONDS = "(epoch_us({b}) - epoch_us({a})) / 1e6::DOUBLE"

_SNAP = f"""{_EVENTS},
p0 AS (SELECT *, row_number() OVER w AS step, {_SECONDS.format(a='lag(ts) OVER w', b='ts')} AS gap_seconds, (lag(event_type) OVER w IS DISTINCT FROM event_type)::BIGINT AS change FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p1 AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS phase_number FROM p0),
p2 AS (SELECT *, row_number() OVER w - 1 AS steps, {_SECONDS.format(a='first_value(ts) OVER w', b='ts')} AS elapsed FROM p1 WINDOW w AS (PARTITION BY user_id, phase_number ORDER BY ts, event_id)),
p3 AS (SELECT *, CASE WHEN steps > 0 AND elapsed > 0 THEN steps / elapsed END AS steps_per_second FROM p2)"""


@register("progress_snapshots", f"WITH {_SNAP} SELECT user_id, event_id, step, gap_seconds, phase_number, round(steps_per_second, 9) AS steps_per_second, round(CASE WHEN step <= {_TOTAL} THEN ({_TOTAL} - step) / steps_per_second END, 3) AS eta_seconds, 100.0::DOUBLE * step / {_TOTAL} AS percent, CASE WHEN gap_seconds >= {_STALL} THEN 'warning_possible_stall' ELSE 'running' END AS status FROM p3")
def progress_snapshots(spark, sf_dir):
    rows = progress.snapshots(events(spark, sf_dir), "user_id", "ts", "event_id", "event_type", _STALL, _TOTAL)
    return rows.select("user_id", "event_id", "step", "gap_seconds", "phase_number", F.round("steps_per_second", 9).alias("steps_per_second"), F.round("eta_seconds", 3).alias("eta_seconds"), "percent", "status")


@register("event_stall_gaps", f"WITH {_SNAP} SELECT user_id, count(*) AS stalls, max(gap_seconds) AS longest_seconds FROM p3 WHERE gap_seconds >= {_STALL} GROUP BY user_id")
def event_stall_gaps(spark, sf_dir):
    rows = progress.snapshots(events(spark, sf_dir), "user_id", "ts", "event_id", "event_type", _STALL, _TOTAL).filter("status = 'warning_possible_stall'")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("stalls"), F.max("gap_seconds").alias("longest_seconds"))


@register(
    "hysteresis_episodes",
    f"""WITH {_EVENTS}, h0 AS (SELECT *, coalesce(last_value(CASE WHEN value >= 80 THEN 1 WHEN value <= 40 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS state FROM ev),
    h1 AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS was FROM h0),
    h2 AS (SELECT *, sum((state = 1 AND was = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS episode FROM h1)
    SELECT user_id, episode, min(ts) AS start_ts, max(ts) AS end_ts, min(state) = 0 AS ended, {_SECONDS.format(a='min(ts)', b='max(ts)')} AS seconds FROM h2 WHERE state = 1 OR was = 1 GROUP BY 1, 2""",
)
def hysteresis_episodes(spark, sf_dir):
    out = progress.hysteresis(events(spark, sf_dir), "user_id", "ts", "event_id", "value", 80, 40)
    return out.withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz")).withColumn("end_ts", F.col("end_ts").cast("timestamp_ntz"))


@register("telemetry_rollup", f"WITH {_EVENTS} SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, max(value) AS max_value, avg(value) AS mean_value, max(k) AS max_optional, avg(k) AS mean_optional, count(k) AS n_optional FROM ev GROUP BY 1, 2")
def telemetry_rollup(spark, sf_dir):
    return progress.telemetry(events(spark, sf_dir), ["event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")], "value", "k")


@register("runtime_throughput", f"WITH s AS (SELECT event_type, count(*) AS n, sum(value) AS amount, {_SECONDS.format(a='min(ts)', b='max(ts)')} AS elapsed FROM events GROUP BY 1) SELECT event_type, n, elapsed, coalesce(n / nullif(elapsed, 0), 0) AS events_per_second, round(coalesce(amount / nullif(elapsed, 0), 0), 9) AS amount_per_second FROM s")
def runtime_throughput(spark, sf_dir):
    return progress.throughput(events(spark, sf_dir), "event_type", "ts", "value").withColumn("amount_per_second", F.round("amount_per_second", 9))


@register("telemetry_stream", f"WITH {_EVENTS}, w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, max(value) AS max_value, avg(value) AS mean_value, max(k) AS max_optional, avg(k) AS mean_optional, count(k) AS n_optional FROM ev GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def telemetry_stream(spark, sf_dir):
    """The streaming windows over the event file: the windows that the watermark has closed."""
    from millrace.streaming.progress import windows
    from millrace.streaming.run import available_rows, file_stream

    stream = file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    rows = windows(stream.withColumn("k", F.when(F.col("k") % 5 != 0, F.col("k"))), "ts", "event_type", "value", "k")
    return available_rows(rows).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("hysteresis_stream", f"WITH {_EVENTS}, h0 AS (SELECT *, coalesce(last_value(CASE WHEN value >= 80 THEN 1 WHEN value <= 40 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS state FROM ev), h1 AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS was FROM h0), h2 AS (SELECT *, sum((state = 1 AND was = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS episode FROM h1) SELECT user_id, episode, {_SECONDS.format(a='min(ts)', b='max(ts)')} AS seconds FROM h2 WHERE state = 1 OR was = 1 GROUP BY 1, 2 HAVING min(state) = 0")
def hysteresis_stream(spark, sf_dir):
    """Pauses by keyed state over the event file as a stream: those that have ended."""
    from millrace.streaming.progress import hysteresis
    from millrace.streaming.run import available_rows, file_stream

    stream = file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return available_rows(hysteresis(stream, "user_id", "ts", "event_id", "value", 80, 40)).select("user_id", "episode", "seconds")


@register("event_silences", f"WITH n AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM (SELECT DISTINCT user_id, ts FROM events)) SELECT user_id, ts AS since FROM n WHERE {_SECONDS.format(a='ts', b='next')} >= {_STALL} OR next IS NULL AND ts + INTERVAL {_STALL} SECOND <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def event_silences(spark, sf_dir):
    """Stretches without events by registered timers over the event file as a stream: also those of users of whom nothing comes any more."""
    from millrace.streaming.liveness import rocksdb_state, silences
    from millrace.streaming.run import available_rows, file_stream

    stream = file_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    with rocksdb_state(spark):
        return available_rows(silences(stream, "user_id", "ts", _STALL)).withColumn("since", F.col("since").cast("timestamp_ntz"))


@register("resumed_pauses", ORACLES["hysteresis_stream"])
def resumed_pauses(spark, sf_dir):
    """The pauses of hysteresis_stream by a query that stops after the first half of the events and takes its checkpoint up again."""
    from millrace.sources.sinks import shared_folder
    from millrace.streaming.progress import hysteresis
    from millrace.streaming.run import available_rows

    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    middle = rows.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    folder = shared_folder(spark, "resumed")
    out = None
    for k, some in enumerate((F.unix_micros("ts") <= middle, F.unix_micros("ts") > middle)):
        rows.filter(some).write.parquet(f"{folder}/in/half={k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        out = available_rows(hysteresis(stream, "user_id", "ts", "event_id", "value", 80, 40), f"{folder}/run")
    return out.select("user_id", "episode", "seconds")


@register("event_log", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events, round(sum(value), 4) AS amount FROM events GROUP BY 1")
def event_log(spark, sf_dir):
    """Events appended to a log of JSON lines by a stream that runs twice: what the log holds."""
    from millrace.sources.sinks import shared_folder
    from millrace.streaming.progress import log
    from millrace.streaming.run import file_stream

    folder = shared_folder(spark, "log")
    for _ in range(2):
        stream = file_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
        log(stream, f"{folder}/lines", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.schema("event_id long, event_type string, value double").json(f"{folder}/lines")
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"), F.round(F.sum("value"), 4).alias("amount"))
