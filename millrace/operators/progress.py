"""Progress, stalls, hysteresis and telemetry over event tables (batch); streaming/ has their counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import share


def seconds(later, earlier):
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def snapshots(events: DataFrame, by: str, ts: str, order: str, phase: str, stall_seconds: float, total_steps: int) -> DataFrame:
    """Every event as a step of its group: steps, percent, gap, rate since its phase began, time left, status."""
    w = Window.partitionBy(by).orderBy(ts, order)
    rows = events.withColumn("step", F.row_number().over(w).cast("bigint")).withColumn("gap_seconds", seconds(F.col(ts), F.lag(ts).over(w)))
    change = (F.lag(phase).over(w).isNull() | (F.lag(phase).over(w) != F.col(phase))).cast("bigint")
    rows = rows.withColumn("phase_number", F.sum(change).over(w))
    p = Window.partitionBy(by, "phase_number").orderBy(ts, order)
    steps = F.row_number().over(p) - 1
    elapsed = seconds(F.col(ts), F.first(ts).over(p))
    rate = F.when((steps > 0) & (elapsed > 0), steps / elapsed)
    left = F.when(F.lit(total_steps) >= F.col("step"), (F.lit(total_steps) - F.col("step")) / F.col("steps_per_second"))
    status = F.when(F.col("gap_seconds") >= stall_seconds, "warning_possible_stall").otherwise("running")
    return rows.withColumn("steps_per_second", rate).withColumn("eta_seconds", left).withColumn("percent", 100.0 * F.col("step") / total_steps).withColumn("status", status)


def hysteresis(events: DataFrame, by: str, ts: str, order: str, value: str, limit: float, resume: float) -> DataFrame:
    """Pauses: one begins at a value of limit or more and ends at the first of resume or less (or with the last event).

    One row per pause: group, number, start, end, seconds, whether it ended.
    """
    w = Window.partitionBy(by).orderBy(ts, order)
    signal = F.when(F.col(value) >= limit, 1).when(F.col(value) <= resume, 0)
    rows = events.withColumn("_state", F.coalesce(F.last(signal, ignorenulls=True).over(w), F.lit(0)))
    rows = rows.withColumn("_was", F.coalesce(F.lag("_state").over(w), F.lit(0))).withColumn("_number", F.sum(((F.col("_state") == 1) & (F.col("_was") == 0)).cast("bigint")).over(w))
    inside = rows.filter((F.col("_state") == 1) | (F.col("_was") == 1))
    out = inside.groupBy(by, F.col("_number").alias("episode")).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), (F.min("_state") == 0).alias("ended"))
    return out.withColumn("seconds", seconds(F.col("end_ts"), F.col("start_ts")))


def telemetry(events: DataFrame, by: list, value: str, optional: str) -> DataFrame:
    """Maximum and mean of a value and of one that may be missing."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), F.max(optional).alias("max_optional"), F.avg(optional).alias("mean_optional"), F.count(optional).alias("n_optional"))


def throughput(events: DataFrame, by: str, ts: str, amount: str) -> DataFrame:
    """Events and amounts a second between a group's first and last event; 0 without time."""
    sums = events.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("amount"), seconds(F.max(ts), F.min(ts)).alias("elapsed"))
    return sums.select(by, "n", "elapsed", F.coalesce(share(F.col("n"), F.col("elapsed")), F.lit(0.0)).alias("events_per_second"), F.coalesce(share(F.col("amount"), F.col("elapsed")), F.lit(0.0)).alias("amount_per_second"))
