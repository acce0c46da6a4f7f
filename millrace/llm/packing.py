"""Operator 1: best-fit packing by exact-complement hashing.

Documents are encoded, an end id is added, and only documents over the sequence length are cut. The packing plan is made
from the histogram of piece lengths alone (at most ``max_len`` counts, whatever the corpus holds): for each length the
plan looks up, in an index by sum, singles, pairs and triples of lengths that fill the gap exactly and consumes as many combinations as the
counts allow at once; what stays is placed best-fit decreasing, again many equal pieces at a time. The plan has a few
thousand runs, each "pieces number a to b of length l go to sequences from s on, k to a sequence, at place o". Pieces get
their number within their length from counts of salted buckets, so no length (even one of a third of all rows) meets in a task.

Defined results: a null or empty text is one piece holding the end id alone; a row that comes twice is packed twice; rows
with a null doc_id are packed like others; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import wordbpe
from millrace.llm.common import identity, located, per_chunk, spread, texts, written

MAX_LEN = 2048
#: Pieces of one length that a task ranks at most, about, when a third of all pieces has it.
BUCKET_ROWS = 300_000
#: Runs of a packing plan.
Run = tuple[int, int, int, int, int, int]  # length, first number, pieces, pieces to a sequence, first sequence, place


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start (ids before it), length, ids (little-endian unsigned 32-bit)."""
    end = np.array([end_id], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> dict:
        encode = wordbpe.load(tokenizer_path).encode
        out = defaultdict(list)
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = encode(text) + end
            for start in range(0, len(ids) // 4, max_len):
                part = ids[4 * start : 4 * (start + max_len)]
                for name, value in (("doc_id", doc_id), ("piece", start // max_len), ("start", start), ("length", len(part) // 4), ("ids", part)):
                    out[name].append(value)
        return {name: out[name] for name in ("doc_id", "piece", "start", "length", "ids")}

    return per_chunk(texts(docs), work, "doc_id long, piece int, start long, length long, ids binary")


class SumIndex:
    """Which sums single lengths, pairs and triples of them give, under the counts that are left.

    Pairs are kept by their sum, largest first, as two arrays; pair_count says for each sum how many of its pairs are still available, and is kept right
    whenever a length runs out, so that a sum without pairs is never looked through; a triple of a sum is a length and a pair of the rest.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        lengths = np.flatnonzero(counts)
        i, j = np.triu_indices(len(lengths))
        large, small = lengths[j], lengths[i]
        fits = large + small < len(counts)
        large, small = large[fits], small[fits]
        order = np.lexsort((-large, large + small))
        self.large, self.small = large[order], small[order]
        self.starts = np.searchsorted(self.large + self.small, np.arange(len(counts) + 1))
        there = (large != small) | (counts[large] > 1)
        self.pair_count = np.bincount((large + small)[there], minlength=len(counts))

    def take(self, length: int, n: int) -> None:
        before = int(self.left[length])
        self.left[length] = after = before - n
        if before > 1 >= after and 2 * length < len(self.left):
            self.pair_count[2 * length] -= 1
        if before and not after:
            others = np.flatnonzero(self.left[: max(0, len(self.left) - length)])
            self.pair_count[others + length] -= 1

    def single(self, total: int) -> bool:
        return bool(self.left[total])

    def pairs(self, total: int, most: int | None = None) -> list[tuple[int, int]]:
        """Available pairs (a >= b, a at most most) with this sum, largest a first."""
        if total < 2 or not self.pair_count[total]:
            return []
        part = slice(self.starts[total], self.starts[total + 1])
        a, b = self.large[part], self.small[part]
        ok = (self.left[a] > 0) & (self.left[b] > (a == b))
        if most is not None:
            ok &= a <= most
        return list(zip(a[ok].tolist(), b[ok].tolist(), strict=True))

    def triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        """Available triples (a >= b >= c) with this sum, largest a first; counts may change between two of them."""
        for a in range(total - 2, (total + 2) // 3 - 1, -1):
            if self.left[a] and self.pair_count[total - a]:
                for b, c in self.pairs(total - a, a):
                    if not self.left[a]:
                        break
                    yield a, b, c


def packing_plan(counts: dict[int, int], max_len: int = MAX_LEN) -> list[Run]:
    """Runs that place each piece of the histogram once; sequences are numbered from 0."""
    start = np.zeros(max_len + 1, np.int64)
    for length, n in counts.items():
        start[length] = n
    index = SumIndex(start)
    left = index.left
    used, runs, sequences = np.zeros(max_len + 1, np.int64), [], 0

    def take(length: int, n: int, each: int, sequence: int, place: int) -> None:
        """n pieces of a length, each to a sequence, at a place."""
        runs.append((length, int(used[length]), n, each, sequence, place))
        used[length] += n
        index.take(length, n)

    def consume(parts: list[int]) -> None:
        """Fills as many sequences with these lengths, exactly, as the counts allow."""
        nonlocal sequences
        need = {x: parts.count(x) for x in parts}
        n = min(int(left[x]) // k for x, k in need.items())
        if n:
            place = 0
            for x, k in need.items():
                take(x, n * k, k, sequences, place)
                place += x * k
            sequences += n

    if left[max_len]:
        consume([max_len])
    for length in range(max_len - 1, 0, -1):
        gap = max_len - length
        if left[length] and index.single(gap):
            consume([length, gap])
        for some in (index.pairs(gap), index.triples(gap)) if left[length] else ():
            for parts in some:
                if not left[length]:
                    break
                consume([length, *parts])
    gaps: list[int] = []  # sorted; equal gaps share a list of (first sequence, sequences)
    open_: dict[int, list[tuple[int, int]]] = {}

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((first, n))

    for length in range(max_len, 0, -1):
        while left[length]:
            n = int(left[length])
            k = bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, bins = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(k)
                each = min(gap // length, max(1, n // bins))
                fill = min(bins, n // each)
                take(length, fill * each, each, first, max_len - gap)
                put(gap - each * length, first, fill)
                put(gap, first + fill, bins - fill)
            else:
                each = min(max_len // length, n)
                bins = n // each
                take(length, bins * each, each, sequences, 0)
                put(max_len - each * length, sequences, bins)
                sequences += bins
    return sorted(runs)


def placed(pieces_df: DataFrame, runs: list[Run], carry: list[str]) -> DataFrame:
    """Pieces with sequence_id and offset: numbers within a length, then a look-up in the plan (of bounded size)."""
    total = sum(r[2] for r in runs)
    buckets = max(16, -(-total // BUCKET_ROWS))
    salted = pieces_df.withColumn("bucket", spread("_file", "_row", parts=buckets).cast("int"))  # by place: rows that are alike spread too
    cells = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = cells.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("_file", "_row")
    numbered = salted.withColumn("place", F.row_number().over(order) - 1).join(before, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("place"))
    table = np.array(runs, np.int64).reshape(-1, 6)
    keys = table[:, 0] << 44 | table[:, 1]

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def look_up(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        run = table[np.searchsorted(keys, length.to_numpy() << 44 | number.to_numpy(), "right") - 1]
        k = number.to_numpy() - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 4] + k // run[:, 3], "offset": run[:, 5] + k % run[:, 3] * run[:, 0]})

    return numbered.withColumn("at", look_up("length", "number")).select(*carry, F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = 0, carry: dict[str, Column] | None = None) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, the carried columns, sequence_id, offset.

    carry: columns made from a piece's row (its ids, say) where it is, before rows move; by default the ids themselves.
    """
    carry = {"ids": F.col("ids")} if carry is None else carry
    table = written(pieces(docs, tokenizer_path, max_len, end_id))
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most max_len rows
    table, place = located(table)
    file, row = identity(place)
    slim = table.select("doc_id", "piece", "start", "length", *[v.alias(k) for k, v in carry.items()], file.alias("_file"), row.alias("_row"))
    return placed(slim, packing_plan(counts, max_len), ["doc_id", "piece", "start", "length", *carry])
