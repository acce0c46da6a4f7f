"""Operator 8: n-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed five-word shingles. Equal sets are one class (its copies are counted, never paired). Candidates
are classes that agree in a band of MinHash values; two sets of similarity 0.8 agree in none of the 32 bands of 4 with a
probability of 5e-8. A pair's values are compared 32 at a time and the pair is dropped as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold is below the tolerance. Survivors give clusters:
only a spanning forest of them leaves a task. In each cluster, the pairs are pruned again by the same rule, and the rest is
verified exactly by intersecting the shingle sets. Buckets and clusters over a block's size are worked through in blocks, two
at a time, by as many tasks; none is capped, and a task never holds more than two blocks.

Defined results: null text counts as empty; texts without words are copies of each other; a text of fewer than five words has
one shingle of all its words; rows that come twice are copies; a null doc_id is a document like others; extra columns are
dropped; an empty table gives no rows. Sets are told apart by 64-bit digests. Each class's text is that of one row, found by the row's own place, whatever
its doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, identity, located, looked_up, per_chunk, texts, written
from millrace.llm.graph import components
from millrace.llm.shingles import minhashes, shingle_sets

THRESHOLD, BANDS, ROWS, STEP, TOLERANCE = 0.8, 32, 4, 32, 1e-7
#: A block of a bucket, in members (a quarter of a kilobyte each); a block of a cluster, in members and in shingles of their texts. Two blocks
#: at most meet in a task.
BUCKET_BLOCK, BLOCK, BLOCK_SHINGLES = 4096, 512, 400_000
#: Pairs compared at once.
PAIRS = 1 << 16


def least_matches(hashes: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values among so many with which the similarity's posterior still reaches the threshold.

    With a uniform prior and m of k equal, P(s >= t) = P(Binomial(k + 1, t) <= m).
    """
    total = 0.0
    for m in range(hashes + 1):
        total += comb(hashes + 1, m) * threshold**m * (1 - threshold) ** (hashes + 1 - m)
        if total >= tolerance:
            return m
    return hashes


def _digests(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(found[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, set (digest of the shingle set), n (its size), sig (BANDS * ROWS 16-bit MinHash values), and the columns to carry."""

    def work(batch: pa.RecordBatch) -> dict:
        found, starts = shingle_sets(batch.column("text").to_pylist())
        sig = minhashes(found, starts, BANDS * ROWS)
        return {"doc_id": batch.column("doc_id"), "set": _digests(found, starts), "n": np.diff(starts), "sig": [s.tobytes() for s in sig]}

    return per_chunk(texts(docs, carry), work, "doc_id long, set long, n long, sig binary", carry=carry)


def survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of the pairs that neither sizes nor posterior rule out."""
    a, b = sizes[left], sizes[right]
    alive = np.flatnonzero(np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)
    matches = np.zeros(len(left), np.int32)
    for low in range(0, BANDS * ROWS, STEP):
        if not len(alive):
            break
        matches[alive] += (sig[left[alive], low : low + STEP] == sig[right[alive], low : low + STEP]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least_matches(low + STEP, threshold, TOLERANCE)]
    return alive


def pairs(starts: np.ndarray, sizes: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within groups of sorted rows, a bounded number at a time; in groups of two blocks, pairs across them."""
    for m in np.unique(sizes[(sizes > 1) & (sizes <= 64)]):
        group = starts[sizes == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, PAIRS // len(i))
        for low in range(0, len(group), step):
            left, right = (group[low : low + step, None] + i).ravel(), (group[low : low + step, None] + j).ravel()
            across = (side[left] != side[right]) | (side[left] == 0)
            yield left[across], right[across]
    for begin, m in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        rows = np.arange(begin, begin + m)
        sides = side[begin : begin + m]
        one = not sides.any()
        xs, ys = (rows, rows) if one else (rows[sides == 1], rows[sides == 2])
        step = max(1, PAIRS // max(1, len(ys)))
        for low in range(0, len(xs), step):
            left = np.repeat(xs[low : low + step], len(ys))
            right = np.tile(ys, len(xs[low : low + step]))
            yield (left[left < right], right[left < right]) if one else (left, right)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least number reachable from each of n rows."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, least)
        np.minimum.at(after, right, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def heads(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row the least id that it can reach: the same in all buckets that hold a group's least member."""
    label = forest(len(ids), left, right)
    least = ids.copy()
    np.minimum.at(least, label, ids)
    return least[label]


def blocked(rows: DataFrame, size: str, member: str, block: int, weight: str | None = None) -> DataFrame:
    """Deals each group's rows to tasks: one for a group of one block, else one for each two blocks. Adds first, second, side."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    if weight:
        blocks = F.least(F.greatest(blocks, F.ceil(F.col(weight) / BLOCK_SHINGLES).cast("int")), F.col(size).cast("int"))
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    both = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("first"), F.greatest(own, o).alias("second"), F.when(own == o, 0).when(own < o, 1).otherwise(2).cast("int").alias("side")))
    return rows.withColumn("_at", F.explode(both)).select("*", "_at.first", "_at.second", "_at.side").drop("_at")


def grouped(df: DataFrame, key: str, by: str, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over whole groups (key, first, second) of rows that were dealt and sorted by them: as many groups to a call
    as lie in CHUNK_BYTES of the column by."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in (part for whole in batches for part in chunks(whole, by)):
            ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (key, "first", "second")])
            change = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1
            cut = 0 if last is None or (ids[:, 0] != last).any() else None
            if cut == 0 and held:
                yield work(pa.Table.from_batches(held))
                held = []
            if len(change):
                held.append(batch.slice(0, int(change[-1])))
                yield work(pa.Table.from_batches(held))
                held = [batch.slice(int(change[-1]))]
            else:
                held.append(batch)
            last = ids[:, -1]
        if held:
            yield work(pa.Table.from_batches(held))

    return df.repartition(key, "first", "second").sortWithinPartitions(key, "first", "second", "side").mapInArrow(run, schema)


def bounds(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the groups, and each row's side."""
    ids = np.stack([table.column(c).to_numpy().astype(np.int64) for c in (key, "first", "second")])
    starts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1])
    return starts, np.diff(np.append(starts, table.num_rows)), table.column("side").to_numpy()


def _sigs(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def band_rows(classes: DataFrame) -> DataFrame:
    """set and bucket: one row for each band."""

    def run(batches):
        schema = pa.schema([("set", pa.int64()), ("bucket", pa.int64())])
        for batch in batches:
            if batch.num_rows:
                keys = _sigs(pa.Table.from_batches([batch])).reshape(-1, BANDS, ROWS).astype("<u2").tobytes()
                keys = np.frombuffer(keys, "<u8").reshape(-1, BANDS) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("set").to_numpy(), BANDS)), pa.array(keys.ravel().view(np.int64))], schema=schema)

    return classes.filter("n > 0").select("set", "sig").mapInArrow(run, "set long, bucket long")


def likely_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """A spanning forest, bucket by bucket, of the candidate pairs that pruning leaves: a, b."""
    bands = written(band_rows(classes))
    full = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = bands.join(full, "bucket").join(classes.select("set", "n", "sig"), "set")

    def work(table: pa.Table) -> pa.RecordBatch:
        starts, sizes, side = bounds(table, "bucket")
        sig, n = _sigs(table), table.column("n").to_numpy()
        found = [(left[ok], right[ok]) for left, right in pairs(starts, sizes, side) if len(ok := survivors(sig, left, right, n, threshold))]
        left, right = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        ids = table.column("set").to_numpy()
        head = heads(ids, left, right)
        linked = np.flatnonzero(ids != head)
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(head[linked])], names=["a", "b"])

    return grouped(blocked(members, "size", "set", BUCKET_BLOCK), "bucket", "sig", work, "a long, b long")


def verified(clustered: DataFrame, threshold: float) -> DataFrame:
    """Exact links within clusters. Input: cluster, size, weight (its shingles), set, copies, n, sig, text. Output rows per set and task: set, label
    (the least set that links reach), classes, documents (linked to the set in this task)."""

    def work(table: pa.Table) -> pa.RecordBatch:
        starts, sizes, side = bounds(table, "cluster")
        sig, ids, copies = _sigs(table), table.column("set").to_numpy(), table.column("copies").to_numpy()
        sets, at = shingle_sets(table.column("text").to_pylist())
        size = np.diff(at)
        classes, documents = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        lefts, rights = [], []
        values, code = np.unique(sets, return_inverse=True)
        for left, right in pairs(starts, sizes, side):
            ok = survivors(sig, left, right, size, threshold)
            left, right = left[ok], right[ok]
            common = intersections(code, at, left, right)
            linked = common >= threshold * (size[left] + size[right] - common) - 1e-9
            left, right = left[linked], right[linked]
            for x, y in ((left, right), (right, left)):
                classes += np.bincount(x, minlength=len(ids))
                documents += np.bincount(x, copies[y], len(ids)).astype(np.int64)
            lefts.append(left)
            rights.append(right)
        head = heads(ids, np.concatenate(lefts), np.concatenate(rights)) if lefts else ids
        keep = np.flatnonzero(classes)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(head[keep]), pa.array(classes[keep]), pa.array(documents[keep])], names=["set", "label", "classes", "documents"])

    return grouped(blocked(clustered, "size", "set", BLOCK, "weight"), "cluster", "text", work, "set long, label long, classes long, documents long")


def intersections(code: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the common parts of sets (sorted, distinct codes; set k from at[k] to at[k + 1])."""
    out = np.zeros(len(left), np.int64)
    if not len(left):
        return out
    size = np.diff(at)
    mark = np.zeros(int(code.max()) + 1 if len(code) else 1, np.int8)
    order = np.argsort(left, kind="stable")
    cuts = np.flatnonzero(np.diff(left[order])) + 1
    for some in np.split(order, cuts):
        own = code[at[left[some[0]]] : at[left[some[0]] + 1]]
        mark[own] = 1
        for low in range(0, len(some), 256):
            part = some[low : low + 256]
            length = size[right[part]]
            ends = np.cumsum(length)
            index = np.arange(ends[-1]) + np.repeat(at[right[part]] - (ends - length), length)
            out[part] = np.add.reduceat(mark[code[index]], ends - length, dtype=np.int64) if (length > 0).all() else 0
        mark[own] = 0
    return out


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id among all that links join), n_links (other documents of at
    least this similarity, copies too), n_different (linked classes of other sets), copies (documents of the same set), label (equal where class_id's documents are
    the same, null doc_ids too), and the columns to carry."""
    docs, place = located(docs)
    file, row = (c + "_" * sum(map(len, carry)) for c in ("file", "row"))  # longer than any column to carry
    docs = docs.select("doc_id", "text", *carry, *(c.alias(n) for c, n in zip(identity(place), (file, row), strict=True)))
    rows = written(signatures(docs, (*carry, file, row)))
    one = [F.first(c).alias(c) for c in ("n", "sig", file, row)]  # all of one row: its text stands for the class
    classes = written(rows.groupBy("set").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), *one))
    clusters = components(written(likely_edges(classes, threshold).distinct())).select(F.col("id").alias("set"), F.col("label").alias("cluster"))
    members = written(clusters.join(classes, "set"))
    sizes = written(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")))
    wanted = looked_up(members, sizes, ["cluster"], "size", ["set"], "inner")
    whole = texts(docs, (file, row)).drop("doc_id")
    with_text = wanted.join(whole, [file, row]).select("cluster", "size", "weight", "set", "copies", "n", "sig", "text")
    links = written(verified(with_text, threshold))
    counts = links.groupBy("set").agg(F.sum("classes").alias("classes"), F.sum("documents").alias("documents"))
    joined = components(links.select(F.col("set").alias("a"), F.col("label").alias("b"))).select(F.col("id").alias("set"), "label")
    named = written(classes.select("set", "copies", "least").join(joined, "set", "left").withColumn("label", F.coalesce("label", "set")))
    least = written(named.groupBy("label").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("classes_")))
    per_class = looked_up(named, least, ["label"], "classes_", ["set"], "inner").join(counts, "set", "left").select("set", "copies", "class_id", "label", F.coalesce("classes", F.lit(0)).alias("n_different"), (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = looked_up(rows.select("doc_id", "set", file, row, *carry), written(per_class), ["set"], "copies", [file, row], "inner")
    return found.select("doc_id", "class_id", "n_links", "n_different", "copies", "label", *carry)
