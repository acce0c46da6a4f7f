"""Operator 6: contiguous balanced shards by global prefix sums of byte sizes, in DataFrame operations alone.

Rows are ordered by a hash of the text, then doc_id, then their place in the files, so that equal texts lie side by side, and dealt to partitions by range
(a hot text is split by doc_id, rows that share that too by their places). Every partition's total gives, by prefix sums over the partitions (one row each), the bytes
before it; with a running sum inside the partition each row knows the bytes before it, and equal targets cut the order. A row lies in the shard in which its first byte does: no shard's
bytes are further from the target than the largest row's. Groups of equal texts are cut where a target ends, like all else.

Defined results: a null text has size 16 (none and the row's 16); a null doc_id sorts first; rows that come twice take two
slots; an empty table gives no rows; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import identity, located, written

ROW_BYTES = 16


def byte_shards(docs: DataFrame, shards: int = 40, parts: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    if not parts:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs, place = located(docs)
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("group"), *identity(place))
    dealt = written(rows.repartitionByRange(parts, "group", "doc_id", "file", "row").withColumn("part", F.spark_partition_id()))
    order = [F.col("group"), F.col("doc_id").asc_nulls_first(), F.col("file"), F.col("row")]
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"))  # a row for each partition
    before = totals.select("part", (F.sum("bytes").over(Window.orderBy("part")) - F.col("bytes")).alias("part_start"))
    total = dealt.agg(F.sum("size").alias("n")).first()["n"] or 0
    inside = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    summed = dealt.join(F.broadcast(before), "part").withColumn("start", F.col("part_start") + F.coalesce(inside, F.lit(0)))
    shard = F.least(F.floor(F.col("start") * shards / max(total, 1)), F.lit(shards - 1)).cast("int")
    cut = written(summed.select("doc_id", "size", "text_crc32", "group", "file", "row", "part", shard.alias("shard")))
    # slots, by the same two steps
    cells = cut.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # shards + partitions rows at most, as both only rise
    offsets = cells.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("slot_start"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order)) - 1
    return cut.join(F.broadcast(offsets), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot_start") + place).alias("slot"))
