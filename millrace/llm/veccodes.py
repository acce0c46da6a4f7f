"""Operator 12: product codes of vectors, whose entries are found by Exponion search in exact whole numbers.

Components become floor(1024 x); vectors are cut into equal parts, and each part has a codebook of at most 256 entries. In every round each part goes to the
nearest entry. The search starts at the part's entry of the round before: no entry can be nearer than that one, at squared distance u, unless
its own squared distance to that entry is at most 4u (by the triangle inequality), so of the entry's neighbours, sorted by distance, only the head of the list up to
4u is looked at. Equal distances go to the lower index, so the results don't depend on the start.

Rounds run as Spark jobs: tasks keep rows in bounded Arrow batches and hand on each part's sums and counts by entry (added up in the task first); the driver holds codebooks
alone (parts x 256 entries). Codes between rounds lie in written tables beside the vectors, so a lost executor costs the current round.

Distances are sums in float64 where all terms are below 2^53, which are exact whole numbers, and in Python's whole numbers beyond.

Defined results: a vector that is null or empty, or holds null or non-finite components, is dropped; the initial entries are those of the smallest vec_ids, of
rows that share one the smaller vector's, null vec_ids last, and there are as many entries as kept rows if these are fewer than 256; an entry that no part uses stays; rows that come twice count
twice; error and label_error are null where they pass 64 bits; all vectors have one length that the number of parts divides, else it is an error (ValueError) that tells
the lengths; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, shared_folder, written

#: Production parameters.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one step of numpy work, and how far sums of products are exact in float64.
STEP, EXACT = 4096, 1 << 53
#: Sums leave the tasks in limbs of so many bits, so that they have no bound.
LIMB = 32
HOT_ROWS, HOT_SHARE = 1000, 10_000


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x) as float64 where that is exact, else as Python's whole numbers. The scale is a power of two."""
    wide = x.astype(np.float64)
    if not wide.size or np.abs(wide).max() < EXACT / scale:
        return np.floor(wide * scale)
    flat = [int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale)) if abs(v) < EXACT / scale else int(v * scale // 1) for v in wide.ravel().tolist()]
    return np.array(flat, object).reshape(wide.shape)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays (rows of components) as float64 where squared distances between their rows are exact in it, else as Python's whole numbers."""
    top = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    if 4 * max(a.shape[1] for a in arrays) * top * top < EXACT:
        return [a.astype(np.float64) for a in arrays]
    return [a if a.dtype == object else np.array([int(v) for v in a.ravel()], object).reshape(a.shape) for a in arrays]


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact as the arrays are."""
    return (points * points).sum(axis=1)[:, None] - 2 * points.dot(entries.T) + (entries * entries).sum(axis=1)[None, :]


class Entries:
    """A part's codebook with every entry's neighbours in order of distance."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        between = distances(*exact(entries, entries))
        self.order = np.array([np.lexsort((np.arange(len(row)), row)) for row in between], np.int64).reshape(len(entries), -1)
        self.near = np.take_along_axis(between, self.order, axis=1)
        self.looked = 0  # distances that searches have computed

    def nearest(self, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's nearest entry (the lowest index of equals) and squared distance, searched from its start."""
        codes, found = np.array(start, np.int64), np.zeros(len(points), object)
        by = np.argsort(start, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(start[by], prepend=-1)), len(by))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            rows = by[low:high]
            own = int(start[rows[0]])
            some, entries = exact(points[rows], self.entries)
            u = distances(some, entries[own : own + 1])[:, 0]
            many = np.searchsorted(self.near[own], 4 * u, side="right")
            for width in np.unique(np.maximum(16, 1 << np.ceil(np.log2(many)).astype(int))):  # points of like radius share one look
                here = np.flatnonzero((many <= width) & ((many > width // 2) | (width == 16)))
                head = self.order[own, : int(many[here].max())]
                d = distances(some[here], entries[head])
                least = d.min(axis=1)
                codes[rows[here]] = np.where(d == least[:, None], head[None, :], len(entries)).min(axis=1)
                found[rows[here]] = least
                self.looked += d.size
        return codes, found


def limbs(value: int) -> list[int]:
    """A whole number as limbs of LIMB bits, the lowest first; the last has the sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return [*out, value]


def vectors(batch: pa.RecordBatch, parts: int) -> list[np.ndarray]:
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    length = len(flat) // max(len(column), 1)
    cut = whole(flat).reshape(len(column), length)
    return np.split(cut, parts, axis=1)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, STEP):
            yield batch.slice(low, STEP)


def assigned(table: DataFrame, books: list[np.ndarray], parts: int) -> DataFrame:
    """The table with codes and error found anew; a row without codes starts at entry 0."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("codes array<smallint>, error long")
    full = table.drop("codes", "error").schema
    for field in schema:
        full = full.add(field)
    arrow = to_arrow_schema(full)

    def run(batches):
        tools = [Entries(book) for book in books]
        for batch in slices(batches):
            old = np.array(batch.column("codes").flatten(), np.int64).reshape(-1, parts) if "codes" in batch.schema.names else np.zeros((batch.num_rows, parts), np.int64)
            found = [tool.nearest(points, old[:, k]) for k, (tool, points) in enumerate(zip(tools, vectors(batch, parts), strict=True))]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int16)
            errors = [int(e) for e in sum(e for _, e in found)]
            out = {"codes": pa.array(list(codes), pa.list_(pa.int16())), "error": pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())}
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) if f.name in out else batch.column(f.name) for f in arrow], schema=arrow)

    return table.mapInArrow(run, full)


def updated(table: DataFrame, books: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """The codebooks whose used entries are the floors of their parts' means."""
    shape = (parts, len(books[0]), books[0].shape[1])

    def run(batches):
        sums, counts = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
        for batch in slices(batches):
            codes = np.array(batch.column("codes").flatten(), np.int64).reshape(-1, parts)
            for k, points in enumerate(vectors(batch, parts)):
                counts[k] += np.bincount(codes[:, k], minlength=shape[1])
                add = np.zeros(shape[1:], points.dtype)
                (narrow,) = exact(points)  # sums of a step's rows stay exact where squares do
                add = add.astype(narrow.dtype)
                np.add.at(add, codes[:, k], narrow)
                sums[k] += np.array([int(v) for v in add.ravel()], object).reshape(add.shape)
        rows = [(k, e, p, i, limb) for k, e in zip(*np.nonzero(counts), strict=True) for p in range(shape[2]) for i, limb in enumerate(limbs(int(sums[k, e, p])))]
        rows += [(k, e, -1, 0, counts[k, e]) for k, e in zip(*np.nonzero(counts), strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["part", "entry", "place", "limb", "value"])

    partial = table.select("vector", "codes").mapInArrow(run, "part int, entry int, place int, limb int, value long")
    total = partial.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums: dict[tuple, int] = {}
    for x in total.collect():  # bounded: parts x entries x components, and a count for each entry
        at = x["part"], x["entry"], x["place"]
        sums[at] = sums.get(at, 0) + (int(x["value"]) << LIMB * x["limb"])
    new = []
    for k, book in enumerate(books):
        out = np.array([int(v) for v in book.ravel()], object).reshape(book.shape)
        for e in range(shape[1]):
            if (k, e, -1) in sums:
                out[e] = [sums[k, e, p] // sums[k, e, -1] for p in range(shape[2])]
        new.append(out if len(out) and np.abs(out).max() >= EXACT else out.astype(np.float64))
    return new


def kept(embeddings: DataFrame, vector: str) -> DataFrame:
    """vec_id, label and vector of the rows that are used."""
    values = F.col(vector)
    good = values.isNotNull() & (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), values.alias("vector"))


def label_errors(coded: DataFrame) -> DataFrame:
    """The rows with the errors summed over their label, nulls together. Labels with many rows are looked up by broadcast, the others by a join in which those rows are spread."""
    name = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("none"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = written(coded.groupBy(name.alias("name")).agg(F.when(F.count("error") == F.count(F.lit(1)), total).alias("label_error"), F.count(F.lit(1)).alias("n")))
    hot_rows = max(HOT_ROWS, (sums.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT_SHARE)
    hot = F.broadcast(sums.filter(F.col("n") > hot_rows).select(F.col("name").alias("hot"), F.col("label_error").alias("hot_error")))  # HOT_SHARE rows at most
    rows = coded.withColumn("name", name)
    rows = rows.join(hot, F.col("name") == F.col("hot"), "left")
    key = F.when(F.col("hot").isNull(), F.col("name")).otherwise(F.concat(F.lit("hot "), F.xxhash64("vec_id", "codes").cast("string")))
    rows = rows.withColumn("name", key).join(sums.select("name", "label_error").hint("merge"), "name", "left")
    limit = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    error = F.when(F.col("hot").isNull(), F.col("label_error")).otherwise(F.col("hot_error"))
    return rows.withColumn("label_error", F.when(error <= limit, error).cast("long")).drop("name", "hot", "hot_error")


def compress(embeddings: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """One row per kept vector: vec_id, label, vector, codes (an entry of each part's codebook), error, label_error; and the codebooks (entries by components)."""
    spark = embeddings.sparkSession
    folder = shared_folder(spark)
    table = written(kept(embeddings, vector), folder)
    sizes = [x["size"] for x in table.select(F.size("vector").alias("size")).distinct().limit(10).collect()]
    if len(sizes) > 1 or any(n % parts for n in sizes):
        raise ValueError(f"vectors must have one length that {parts} divides; some have {sorted(sizes)}")
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    found = whole(np.array([x["vector"] for x in first], np.float64).reshape(len(first), sizes[0] if sizes else parts))
    books = np.split(found, parts, axis=1)
    for step in range(rounds + 1 if first else 0):
        old, folder = folder, shared_folder(spark)
        table = written(assigned(table, books, parts), folder)
        discard(spark, [old])
        if step < rounds:
            books = updated(table, books, parts)
    if not first:
        table = table.withColumns({"codes": F.array().cast("array<smallint>"), "error": F.lit(None).cast("long")})
    return label_errors(table), books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def hex_code(codes: str = "codes"):
    """Two hexadecimal digits for each part's entry."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c.cast("int")), 2, "0"))), "")
