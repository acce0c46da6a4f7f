"""Which texts hold given passages whole, anywhere: a join on blocks, then a check of the whole passage.

A text is cut into blocks of a fixed size from its start. A passage of at least two blocks less one character that lies anywhere in it covers
one of its blocks whole, so the passage gives a window for each place in a block where it can begin: of the windows that stand
so, the one that the fewest passages have. Texts give one row for each different block, passages a fixed number of rows. Passages that are too
short for large blocks go by smaller ones, down to one character, and texts are cut into blocks of a size only if some passage goes by it.

Defined results: null texts and null passages have no hits; an empty passage lies in every text; passages lose the spaces around them; equal
pairs come once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a block, largest first; the last finds every passage that isn't empty.
BLOCKS = (32, 8, 4, 2, 1)


def blocks(text: Column, size: int) -> Column:
    """The whole blocks from a text's start, in time linear in the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{size}}}"), F.lit(0))


def windows(items: DataFrame, size: int) -> DataFrame:
    """window (a hash), and item and passage: for each place in a block, the passage's window that the fewest passages have."""
    places = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.transform(blocks(F.substr("passage", k), size), lambda w: F.xxhash64(w)))
    every = items.select("item", "passage", F.posexplode(places).alias("place", "found")).select("item", "passage", "place", F.explode("found").alias("window"))
    shared = every.select("passage", "window").distinct().groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    best = every.join(shared, "window").groupBy("item", "passage", "place").agg(F.min(F.struct("n", "window"))["window"].alias("window"))
    return best.select("window", "item", "passage").distinct()


def holding(docs: DataFrame, items: DataFrame, key: str, item: str, text: str = "text") -> DataFrame:
    """Pairs (key, item) of the texts that hold an item's text whole."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    wanted = items.select(F.col(item).alias("item"), F.trim(text).alias("passage")).filter("passage is not null").distinct()
    length = F.char_length("passage")
    size_of = reduce(lambda rest, size: F.when(length >= 2 * size - 1, F.lit(size)).otherwise(rest), reversed(BLOCKS), F.lit(0))
    wanted = wanted.withColumn("size", size_of)
    present = {x["size"] for x in wanted.select("size").distinct().collect()}  # a row for each size of block
    parts = [rows.select("key", F.lit(None).cast(wanted.schema["item"].dataType).alias("item")).limit(0)]
    for size in (size for size in BLOCKS if size in present):
        seen = rows.select("key", F.explode(F.array_distinct(F.transform(blocks(F.col("text"), size), lambda b: F.xxhash64(b)))).alias("window"))
        met = seen.join(windows(wanted.filter(F.col("size") == size), size), "window").select(F.col("key").alias("met"), "item", "passage").distinct()
        parts.append(met.join(rows, F.col("met").eqNullSafe(F.col("key"))).filter(F.col("text").contains(F.col("passage"))).select("key", "item"))
    if 0 in present:  # an empty passage lies in every text: each pair is a result
        parts.append(rows.join(wanted.filter("size = 0"), F.col("text").contains(F.col("passage"))).select("key", "item"))
    return reduce(DataFrame.unionAll, parts).distinct().select(F.col("key").alias(key), F.col("item").alias(item))
