"""Operator 3: stateful streaming exact deduplication, in DataFrame and Structured Streaming operations alone.

Each row's digest, doc_id and content locator (file and row number) go to a feed table. A stream reads what is new in the feed and keeps, in RocksDB on
disk and without expiry, one state row per digest: how many rows had it, and the largest (doc_id, locator), which is
the row that stays. With a lasting state folder a later call's rows meet the digests of all calls before. Then the full bytes of all hits
are compared: the smallest and the largest text of each digest that came twice must be one and the same, where texts of earlier
calls are read by their locators. Digests that fail this are grouped by whole text.

A hot digest never meets in a task: state is partly aggregated before it moves, and the few digests with more rows than a
ten-thousandth of all (so ten thousand digests at most) are looked up by broadcast and salted elsewhere.

The number of state partitions is that of shuffle partitions when a state folder is first used, for good.

Defined results: null text counts as empty, and empty texts are equal to each other; of equal texts the largest doc_id stays;
of rows that also share the doc_id the one latest in the files stays; a null doc_id is below all others and is kept only if
no other row has the text; extra columns change nothing, whatever their names; rows of joined, united or exploded tables are rows of their own; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import located, shared_folder, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The stream's settings: state on disk, a change log instead of whole snapshots, no space set aside before it is used.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: A digest is hot with more rows than this and than a HOT_SHARE-th of all rows; results are the same either way.
HOT_ROWS, HOT_SHARE = 1000, 10_000


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def keyed_state(feed: str, schema, state: str, spark) -> DataFrame:
    """Runs the stream over what is new in the feed; digest, n, keep (doc_id and place of the row that stays) of all rows that the state has seen."""

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.option("compression", "zstd").mode("overwrite").parquet(f"{state}/changes/batch={batch}")

    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10_000).parquet(f"{feed}/run=*")
        kept = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("who").alias("keep"))
        query = kept.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{state}/log").foreachBatch(store).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    changes = "digest string, n long, keep struct<doc_id: long, place: struct<file: string, row: long>>, batch int"
    found = spark.read.schema(changes).parquet(f"{state}/changes")
    return found.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"))  # both only ever grow


def exists(spark, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def matched(rows: DataFrame, state: DataFrame, hot: DataFrame, how: str = "left") -> DataFrame:
    """Rows with their digest's state: hot digests by broadcast, the others by a join in which hot rows are spread."""
    hot = F.broadcast(hot.select(F.col("digest").alias("hot_digest"), F.col("n").alias("hot_n"), F.col("keep").alias("hot_keep")))
    rows = rows.join(hot, F.col("digest") == F.col("hot_digest"), "left")
    rows = rows.withColumn("key", F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot "), F.xxhash64("who").cast("string"))))
    rows = rows.join(state.withColumnRenamed("digest", "key").hint("merge"), "key", "left")  # it grows with the rows: never broadcast
    rows = rows.withColumn("n", F.coalesce("hot_n", "n")).withColumn("keep", F.coalesce("hot_keep", "keep")).drop("key", "hot_digest", "hot_n", "hot_keep")
    return rows if how == "left" else rows.filter(F.col("n").isNotNull())


def fetched(spark, located_rows: DataFrame, text_column: str = "text") -> DataFrame:
    """digest, who and the whole text of rows (digest, who) of earlier calls, read by their locators: of the files that these name, the rows that they name."""
    files = [r["file"] for r in located_rows.select("who.place.file").distinct().collect()]  # files, not rows: the driver must list what it reads
    if not files:
        return located_rows.select("digest", "who", F.lit("").alias("full"))
    source = spark.read.parquet(*files)
    meta = source.metadataColumn("_metadata")
    texts = source.select(meta["file_path"].alias("file"), meta["row_index"].alias("row"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("full"))
    wanted = located_rows.select("digest", "who", F.col("who.place.file").alias("file"), F.col("who.place.row").alias("row"))
    return texts.join(wanted.hint("merge"), ["file", "row"]).select("digest", "who", "full")


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state_dir: str | None = None, run: str = "0") -> DataFrame:
    """Every row of docs with: _place, digest, keep_id, group_size, kept.

    digest: any function of the text; results don't depend on it, as hits are compared byte for byte. state_dir: a shared folder whose state
    serves one call after the other: rows are then compared with those of all calls before too (group_size counts them, and no row of this
    call is kept where an earlier one has the text and a larger doc_id); the files of the earlier tables must still be there, as
    their texts are read by locator. run names a call: one that was broken off and is made again with its name counts its rows once, while
    rows that are given again under another name count again.
    """
    spark = docs.sparkSession
    docs, place = located(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    who = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col(place).alias("place"))
    folder = shared_folder(spark)
    lasting = state_dir or folder
    if not exists(spark, f"{lasting}/feed/run={run}/_SUCCESS"):
        written(docs.select(digest(text).alias("digest"), who.alias("who")), f"{lasting}/feed/run={run}")
    schema = docs.select(digest(text).alias("digest"), who.alias("who")).schema
    feed = spark.read.schema(schema).parquet(f"{lasting}/feed/run={run}")
    state = written(keyed_state(f"{lasting}/feed", schema, f"{lasting}/state", spark), f"{folder}/kept")
    hot_rows = max(HOT_ROWS, (state.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT_SHARE)
    hot = state.filter(F.col("n") > hot_rows)
    repeated = state.filter("n > 1")
    full = docs.select(digest(text).alias("digest"), who.alias("who"), text.alias("full"))
    earlier = known = None
    if state_dir:
        before = spark.read.schema(schema.add("run", "string")).parquet(f"{lasting}/feed").filter(F.col("run") != run).select("digest", "who")
        hit = feed.select("digest").distinct()
        earlier = written(before.join(hit, "digest", "left_semi"), f"{folder}/earlier")
        if exists(spark, f"{lasting}/unequal"):
            known = spark.read.schema("digest string, run string").parquet(f"{lasting}/unequal").select("digest").distinct().join(hit, "digest", "left_semi")
    hits = matched(full, repeated.filter(F.col("n") <= hot_rows), hot, "inner")
    if earlier is not None:  # one row of each earlier group suffices, as its rows were compared in their own call
        hits = hits.select("digest", "who", "full").unionByName(fetched(spark, earlier.groupBy("digest").agg(F.max("who").alias("who"))))
    ends = hits.groupBy("digest").agg(F.min("full").alias("low"), F.max("full").alias("high"))
    unequal = ends.filter("low <> high").select("digest")
    unequal = written(unequal if known is None else unequal.union(known).distinct(), f"{lasting}/unequal/run={run}")
    result = matched(feed, state, hot)
    if not unequal.isEmpty():  # different texts under one digest: their groups are made from the whole texts
        apart = full.join(unequal, "digest", "left_semi")
        everything = apart
        if earlier is not None:
            everything = apart.unionByName(fetched(spark, earlier.join(unequal, "digest", "left_semi")))
        groups = everything.groupBy("digest", "full").agg(F.count(F.lit(1)).alias("n"), F.max("who").alias("keep"))
        result = result.join(unequal, "digest", "left_anti").unionByName(apart.join(groups, ["digest", "full"]).drop("full"))
    return result.select(F.col("who.doc_id").alias("doc_id"), F.col("who.place").alias("_place"), "digest", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("who") == F.col("keep")).alias("kept"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    columns = docs.columns
    docs, place = located(docs)
    stay = dedup(docs.drop(place)).filter("kept").select(F.col("_place").alias(place))
    return docs.join(stay.hint("merge"), place, "left_semi").select(*columns)
