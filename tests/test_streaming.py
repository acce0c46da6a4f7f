from pyspark.sql import functions as F

from millrace.operators import progress as batch
from millrace.streaming import progress as stream
from millrace.streaming.run import available_rows, file_stream

SMALL = "/root/testdata/sf0.001"


def events(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("double"))


def test_resumed_pauses_equal_the_batch(spark, tmp_path):
    rows = events(spark)
    middle = rows.agg(F.percentile_approx(F.unix_micros("ts"), 0.5)).first()[0]
    rows.filter(F.unix_micros("ts") <= middle).coalesce(1).write.parquet(f"{tmp_path}/in/day=1")
    folder = f"file://{tmp_path}/run"

    def run():
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        return available_rows(stream.hysteresis(source, "user_id", "ts", "event_id", "value", 80, 40), folder)

    first = run().count()
    rows.filter(F.unix_micros("ts") > middle).coalesce(1).write.parquet(f"{tmp_path}/in/day=2")
    found = {tuple(r) for r in run().select("user_id", "episode", F.round("seconds", 3)).collect()}
    wanted = batch.hysteresis(rows, "user_id", "ts", "event_id", "value", 80, 40).filter("ended").select("user_id", "episode", F.round("seconds", 3))
    assert found == {tuple(r) for r in wanted.collect()} and 0 < first < len(found)


def test_stalls(spark, tmp_path):
    rows = events(spark)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    found = available_rows(stream.stalls(file_stream(spark, f"{tmp_path}/in"), "user_id", "ts", "event_id", 6 * 3600), f"file://{tmp_path}/run")
    closed = {(r["user_id"], round(r["seconds"], 3)) for r in found.filter("not open").collect()}
    wanted = batch.snapshots(rows, "user_id", "ts", "event_id", "event_type", 6 * 3600, 100).filter("status <> 'running'")
    assert closed == {(r["user_id"], round(r["gap_seconds"], 3)) for r in wanted.collect()}


def test_log_writes_once(spark, tmp_path):
    events(spark).drop("props").coalesce(1).write.parquet(f"{tmp_path}/in")
    listener = stream.ProgressLog()
    spark.streams.addListener(listener)
    for _ in range(2):
        stream.log(file_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    spark.streams.removeListener(listener)
    assert spark.read.json(f"{tmp_path}/out").count() == events(spark).count()


def test_batch_pauses(spark):
    rows = spark.createDataFrame([("a", k, k, v) for k, v in enumerate((10.0, 90.0, 60.0, 95.0, 40.0, 85.0))], "g string, i int, t int, v double").withColumn("ts", F.timestamp_seconds("t"))
    found = batch.hysteresis(rows, "g", "ts", "i", "v", 80, 40).orderBy("episode").collect()
    assert [(r["seconds"], r["ended"]) for r in found] == [(3.0, True), (0.0, False)]
    none = batch.throughput(rows.limit(1), "g", "ts", "v").first()
    assert none["events_per_second"] == 0.0


def test_pauses_of_many_keys_in_few_calls(spark, tmp_path):
    """Keys share calls and states, and keep pauses of their own over restarts; null and textual keys too."""
    from pyspark.sql import Row

    rows, wanted = [], set()
    for k in range(60):
        g = None if k == 0 else f"g{k}"
        rows += [Row(g=g, i=3 * k + n, t=10 * n + k, v=v) for n, v in enumerate((90.0, 60.0, 40.0, None, 85.0, float(k)))]
        wanted |= {(g, 1, 20.0)} | ({(g, 2, 10.0)} if k <= 40 else set())
    table = spark.createDataFrame(rows, "g string, i long, t long, v double").withColumn("ts", F.timestamp_seconds("t"))
    found = None
    for half in (F.col("i") % 3 < 0, F.col("t") < 45, F.col("t") >= 45):
        table.filter(half).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
        pauses = stream.hysteresis(source, "g", "ts", "i", "v", 80, 40, buckets=3)
        found = available_rows(pauses, f"file://{tmp_path}/run")
    ordered = table.orderBy("ts").collect()
    assert {tuple(r) for r in found.select("g", "episode", "seconds").collect()} == wanted and len(ordered) == 360
    assert found.filter("unix_micros(end_ts) - unix_micros(start_ts) <> seconds * 1e6").isEmpty()
    log = spark.read.format("state-metadata").load(f"file://{tmp_path}/run/log")
    assert log.count() > 0 and spark.read.format("statestore").load(f"file://{tmp_path}/run/log").count() == 3
