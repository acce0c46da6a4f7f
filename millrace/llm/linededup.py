"""Operator 13: dedup of lines that many documents share, in DataFrame operations alone; documents come back as keep bitmaps, not as text.

Every line's key (the line without ASCII white space at both ends, A-Z lower-cased) gives two 64-bit hashes. The lines, as hashes and places without
their text, are range-partitioned by hash with a secondary sort by document (the largest first) and position. A partition is then streamed once: the
rank of a line's document among those with its hash tells the first occurrence, whose document keeps its lines, and whether enough documents follow.
Dropped positions are gathered by document into a bitmap of the lines that stay, in run lengths: kept, dropped, kept and so on, from the first line.

A hot hash never meets in a task: one frequent-items sketch (approx_top_k, of bounded size) names every hash with more than a HOT_SHARE-th of all lines;
those are counted apart, by partial sums over (hash, document), and their few decisions are broadcast. Which hashes count as hot changes no result.

Defined results: documents are rows, told apart by file and row number; of rows with one doc_id the one latest in the files counts as the larger; a null
doc_id is below all others; a null or empty text has one empty line; a line that a document holds many times is dropped or kept everywhere in
it; rows that come twice are two documents; an empty table gives no rows; extra columns change nothing, whatever their names. Keys are told apart by
128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import identity, located, written

#: White space that is stripped, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Production parameters: a key of this many code points in this many documents loses its lines.
LONG, MANY = 40, 5
#: A hash is hot with more than this share of all lines; the sketch follows ten times as many hashes as can be hot.
HOT_SHARE = 10_000
TRACKED = 100_000


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """ASCII lines take the fast way through lower(), which does more than A-Z only where other letters are."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def hashed_lines(docs: DataFrame, place: str, long: int) -> DataFrame:
    """h1, h2, who (doc_id, file, row) and pos of every line whose key is long enough; the text goes no further."""
    who = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *identity(place))
    split = docs.select(who.alias("who"), F.posexplode(lines(F.col("text"))).alias("pos", "line")).filter(F.octet_length("line") >= long)
    keyed = split.select("who", "pos", key(F.col("line")).alias("key")).filter(F.char_length("key") >= long)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(13), "key").alias("h2"), "who.*", "pos")


def hot_hashes(feed: DataFrame) -> DataFrame:
    """h1 of every hash with more than a HOT_SHARE-th of all lines (others may be among them), TRACKED at most."""
    top = feed.agg(F.expr(f"approx_top_k(h1, {HOT_SHARE}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    named = top.select(F.explode("top").alias("item"), "n").filter(F.col("item.count") > F.col("n") / HOT_SHARE)
    return named.select(F.col("item.item").alias("hot"))


def who() -> Column:
    """A document's rank: the larger doc_id, then the later row."""
    return F.struct("doc_id", "file", "row")


def dropped_lines(feed: DataFrame, many: int, parts: int) -> DataFrame:
    """file, row and pos of every line that goes."""
    hot = written(hot_hashes(feed))
    marked = feed.join(F.broadcast(hot), F.col("h1") == F.col("hot"), "left")
    cold = marked.filter(F.col("hot").isNull()).drop("hot").repartitionByRange(parts, "h1", "h2")
    group = Window.partitionBy("h1", "h2")
    ranked = cold.withColumn("rank", F.dense_rank().over(group.orderBy(F.col("doc_id").desc(), F.col("file").desc(), F.col("row").desc())))
    ranked = ranked.withColumn("documents", F.max("rank").over(group))
    gone = ranked.filter((F.col("rank") > 1) & (F.col("documents") >= many)).select("file", "row", "pos")
    warm = marked.filter(F.col("hot").isNotNull()).drop("hot")
    once = warm.groupBy("h1", "h2", "doc_id", "file", "row").agg(F.lit(1).alias("one"))
    decided = once.groupBy("h1", "h2").agg(F.count("one").alias("documents"), F.max(who()).alias("keeper")).filter(F.col("documents") >= many)
    told = warm.join(F.broadcast(decided), ["h1", "h2"])  # HOT_SHARE rows at most, but for h1's collisions
    return gone.unionByName(told.filter(who() != F.col("keeper")).select("file", "row", "pos"))


def runs(gone: Column, total: Column) -> Column:
    """Run lengths of the bitmap of kept lines, from the sorted positions of the dropped ones: kept, dropped, kept and so on; kept runs may be 0 long."""
    start = F.filter(gone, lambda p, i: (i == 0) | (F.element_at(gone, F.greatest(i, F.lit(1))) != p - 1))
    end = F.filter(gone, lambda p, i: (i == F.size(gone) - 1) | (F.element_at(gone, F.least(i + 2, F.size(gone))) != p + 1))
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.zip_with(start, end, lambda a, b: F.array(a, b + 1))), F.array(total))
    return F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges)), lambda a, b: b - a)


def kept_text(text: Column, keep: Column) -> Column:
    """The lines that a bitmap of run lengths keeps, joined by line ends."""
    bits = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    both = F.arrays_zip(lines(text).alias("line"), bits.alias("stays"))
    return F.array_join(F.transform(F.filter(both, lambda x: x["stays"]), lambda x: x["line"]), "\n")


def dedup_lines(docs: DataFrame, long: int = LONG, many: int = MANY, parts: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs with: doc_id, _place (file and row), n_lines, n_dropped, keep (run lengths of the lines that stay), and the columns to carry."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs, place = located(docs)
    feed = written(hashed_lines(docs, place, long))
    gone = dropped_lines(feed, many, parts).groupBy("file", "row").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    own = {"_place": F.col(place), "_lines": F.size(lines(F.col("text"))), "_file": identity(place)[0], "_row": identity(place)[1]}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in carry if c != "doc_id"), *(v.alias(k) for k, v in own.items()))
    joined = rows.join(gone.hint("merge"), (F.col("_file") == gone["file"]) & (F.col("_row") == gone["row"]), "left")
    some = gone["gone"].isNotNull()
    keep = F.when(some, runs(gone["gone"], F.col("_lines"))).otherwise(F.array("_lines"))
    n_dropped = F.when(some, F.size(gone["gone"])).otherwise(0).cast("long")
    return joined.select("doc_id", *(c for c in carry if c != "doc_id"), "_place", F.col("_lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"), keep.alias("keep"))
