"""The look-up that spreads hot keys."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import common, jaccard
from tests.llm.tables import table


@pytest.mark.parametrize("hot_rows", [0, 5, 1000])
def test_looked_up_is_a_join(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    rows = [(k, k % 7 if k % 3 else 1, "ab"[k % 2], k) for k in range(120)] + [(999, None, "a", 5), (1000, 77, "a", 6)]
    df = spark.createDataFrame(rows, "id long, k long, s string, v long")
    sizes = Counter((k, s) for _, k, s, _ in rows if k is not None and k != 77)
    found = spark.createDataFrame([(k, s, n, f"{k}{s}") for (k, s), n in sizes.items()], "k long, s string, n long, name string")
    left = sorted(common.looked_up(df, found, ["k", "s"], "n", ["id"]).collect())
    assert left == sorted((i, k, s, v, sizes.get((k, s)), f"{k}{s}" if (k, s) in sizes else None) for i, k, s, v in rows)
    inner = sorted(common.looked_up(df, found, ["k", "s"], "n", ["id"], "inner").collect())
    assert inner == [x for x in left if x[4] is not None]
    assert common.looked_up(df.limit(0), found, ["k", "s"], "n", ["id"]).collect() == []
    assert len(common.looked_up(df, found.limit(0), ["k", "s"], "n", ["id"]).collect()) == len(rows)


def test_no_task_holds_a_hot_key(spark):
    """Of 100,000 rows of one key and 20,000 of their own, a task of the join gets no more than a small share."""
    rows = spark.range(120_000).select(F.when(F.col("id") < 100_000, -1).otherwise(F.col("id")).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = common.looked_up(rows, common.written(keys), ["k"], "n", ["id"]).withColumn("p", F.spark_partition_id())
        sizes = [x["count"] for x in found.groupBy("p").count().collect()]
        assert sum(sizes) == 120_000 and len(sizes) == 4 and max(sizes) < 40_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_many_equal_texts_under_null_ids(spark):
    docs = [(None, "the same text of more than five words here")] * 20_000 + [(k, f"text number {k} of its own words and no others {k}") for k in range(200)]
    found = Counter((x["doc_id"], x["copies"], x["n_links"]) for x in jaccard.jaccard_join(table(spark, docs)).collect())
    assert found[(None, 20_000, 19_999)] == 20_000 and sum(n for (d, c, links), n in found.items() if d is not None and c == 1) == 200
