"""Connected components in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id, label (the least id of its component) of every id in edges (a, b).

    Each round maps every vertex to the first of itself and its neighbours, in an order by hashes, and the graph to the mapped
    edges; a share of the vertices goes each time, so that all rounds together handle about twice the first one's
    rows. Rounds are written: neither lineage nor lost executors cost more than one. Only whether edges are left reaches
    the driver.
    """
    ways = (edges.select("a", "b"), edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = written(ways[0].unionByName(ways[1]).filter("a <> b").distinct())
    roots = left.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
    for _ in range(most_rounds):
        if left.isEmpty():
            roots = written(roots)
            least = roots.groupBy("root").agg(F.min("id").alias("label"))
            return roots.join(least, "root").select("id", "label")
        place = lambda c: F.struct(F.xxhash64(c).alias("order"), F.col(c).alias("v"))
        first = left.groupBy("a").agg(F.min(place("b")).alias("other"))
        moves = written(first.select(F.col("a").alias("from"), F.least(F.col("other"), place("a"))["v"].alias("to")))
        roots = written(roots.join(moves.withColumnRenamed("from", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        mapped = left.join(moves.withColumnRenamed("from", "a"), "a").select(F.col("to").alias("a2"), "b").join(moves.withColumnRenamed("from", "b"), "b").select(F.col("a2").alias("a"), F.col("to").alias("b"))
        left = written(mapped.filter("a <> b").distinct())
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
