"""Operator 10: quality classifier by random Fourier features, ridge regression and isotonic calibration.

Each whole text gives a fixed row of statistics (numpy over the bytes of many texts at once). The statistics are standardised
with the labelled rows' moments, mapped to cosines of random projections (which approximate a Gaussian kernel), and the
partitions' normal equations are summed in a tree to one small system that the driver solves. The raw scores of labelled
rows, counted in fixed bins, give an isotonic curve (pool adjacent violators) that turns a raw score to a probability.

Only labelled rows outside the held-out part teach; doc_id, source, lang and labels are never among the statistics.

Defined results: null text counts as empty and is scored like any text; rows that come twice are scored twice; several labels of
a document count as their mean, null labels as none; without any label every score is 0.5; extra columns are dropped; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import per_chunk, texts, written

#: Production parameters.
COMPONENTS, GAMMA, RIDGE, SEED, THRESHOLD = 256, 0.08, 1e-3, 20240607, 0.7
BINS, LOW, HIGH = 4000, -1.0, 2.0
NAMES = ("log_bytes", "log_words", "letters", "upper", "digits", "stops", "commas", "bars", "bangs", "marks", "other_punctuation", "not_ascii", "spaces", "lines", "word_bytes", "word_bytes_spread", "long_words", "capitals", "upper_words", "marked_words", "distinct_words", "repeats", "top_word", "distinct_lines", "entropy")
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def _classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 stop, 5 comma, 6 bar, 7 bang, 8 mark, 9 other punctuation, 10 not ASCII, 11 space, 12 line end."""
    kinds = np.zeros(256, np.uint8)
    for k, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".?", b",;:", b"|", b"!", b"%&$#*@~^=+<>{}[]\\_/", b"\"'()-`", bytes(range(128, 256)), b" \t", b"\r\n"), 1):
        kinds[list(members)] = k
    return kinds


CLASSES = _classes()


def statistics(texts_: list[bytes]) -> np.ndarray:
    """One row of len(NAMES) statistics for each text."""
    n = len(texts_)
    out = np.zeros((n, len(NAMES)), np.float64)
    data = np.frombuffer(b"\n".join(texts_) + b"\n", np.uint8)  # each text ends with a line end of its own
    sizes = np.fromiter(map(len, texts_), np.int64, n)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    doc = np.repeat(np.arange(n), sizes + 1)
    kinds = CLASSES[data]
    counts = np.bincount(doc * 13 + kinds, minlength=n * 13).reshape(n, 13).astype(np.float64)
    counts[:, 12] -= 1
    size = np.maximum(sizes, 1).astype(np.float64)
    gap = kinds >= 11
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    words = np.bincount(doc[begins], minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(words)
    for k, cols in enumerate(((1, 2), (2,), (3,), (4,), (5,), (6,), (7,), (8,), (9,), (10,), (11,), (12,)), 2):
        out[:, k] = counts[:, cols].sum(1) / size
    if len(begins):
        length, owner = (ends - begins).astype(np.float64), doc[begins]
        first, last = kinds[begins], kinds[ends - 1]
        mean = np.bincount(owner, length, n) / some
        out[:, 14] = mean
        out[:, 15] = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0))
        out[:, 16] = np.bincount(owner, length > 20, n) / some
        out[:, 17] = np.bincount(owner, first == 2, n) / some
        uppers = np.add.reduceat((kinds == 2).astype(np.int64), begins)
        out[:, 18] = np.bincount(owner, (uppers > 1) & (uppers >= length / 2), n) / some
        out[:, 19] = np.bincount(owner, (last >= 6) & (last <= 9), n) / some
        word_at = np.cumsum(np.bincount(begins, minlength=len(data))) - 1
        place = np.arange(len(data)) - begins[np.maximum(word_at, 0)]
        mixed = np.where(gap, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63])
        hashes = np.add.reduceat(mixed, begins)
        same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        out[:, 21] = np.bincount(owner[1:], same, n) / some
        keys = hashes ^ (owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        heads = np.flatnonzero(new)
        run, of = np.diff(np.append(heads, len(keys))), owner[order][heads]
        out[:, 20] = np.bincount(of, minlength=n) / some
        top = np.zeros(n)
        np.maximum.at(top, of, run)
        out[:, 22] = top / some
    line_ends = np.flatnonzero(kinds == 12)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    column = np.arange(len(data)) - np.repeat(line_starts, line_ends - line_starts + 1)
    line_key = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POWERS[column & 63], line_starts)
    line_doc = doc[line_ends]
    total_lines = np.bincount(line_doc, minlength=n)
    keys = line_key ^ (line_doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    out[:, 23] = np.bincount(line_doc[order][new], minlength=n) / np.maximum(total_lines, 1)
    letters = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    letters[:, 10] -= 1
    share = letters / size[:, None]
    out[:, 24] = -(share * np.log2(np.maximum(share, 1e-12))).sum(1)
    return out


def features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, x (the statistics of each whole text) and the columns to carry."""

    def work(batch: pa.RecordBatch) -> dict:
        raw = batch.column("text").cast(pa.binary()).to_pylist()
        values = statistics(raw)
        return {"doc_id": batch.column("doc_id"), "x": pa.ListArray.from_arrays(np.arange(len(raw) + 1, dtype=np.int32) * len(NAMES), values.astype(np.float32).ravel())}

    return per_chunk(texts(docs, carry), work, "doc_id long, x array<float>", carry=carry)


class Projection:
    """Standardised statistics to random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, components: int, gamma: float, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1)
        self.weights = random.normal(0, np.sqrt(2 * gamma), (len(mean), components))
        self.phases = random.uniform(0, 2 * np.pi, components)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(z @ self.weights + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(z), 1))])


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, len(NAMES)))


def summed(df: DataFrame, work, width: int) -> np.ndarray:
    """The sum over all partitions of work(pandas frame), a vector of this width: summed in partitions, then in a tree of
    64 to a node, so that neither a task nor the driver meets more than a bounded number of vectors."""

    def partial(frames):
        total = np.zeros(width)
        for frame in frames:
            for low in range(0, len(frame), 4096):
                total += work(frame.iloc[low : low + 4096])
        yield pd.DataFrame({"sums": [total.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum([np.frombuffer(x) for x in frame["sums"]], axis=0).tobytes()]})

    sums = written(df.mapInPandas(partial, "sums binary").select(F.spark_partition_id().alias("part"), "sums"))
    n = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while n > 64:
        n = -(-n // 64)
        sums = written(sums.groupBy(F.floor(F.col("part") / 64).alias("part")).applyInPandas(lambda key, f: add(f).assign(part=key[0]), "sums binary, part long"))
    rows = sums.select("sums").collect()  # at most 64
    return np.sum([np.frombuffer(bytes(r["sums"])) for r in rows], axis=0) if rows else np.zeros(width)


def isotonic(bins: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean bin) and values, rising."""
    blocks: list[list[float]] = []
    for b, k, p in zip(bins, n, positive, strict=True):
        blocks.append([b * k, k, p])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    found = np.array(blocks)
    return found[:, 0] / found[:, 1], found[:, 2] / found[:, 1]


def classify(docs: DataFrame, labels: DataFrame, components: int = COMPONENTS, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score (probability of label 1, 0 to 1) and the columns to carry of every document."""
    spark = docs.sparkSession
    rows = written(features(docs, carry))
    held_out = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    train = written(rows.filter(~held_out).join(taught, "doc_id").select("x", "y"))
    d = len(NAMES)

    def moments(frame: pd.DataFrame) -> np.ndarray:
        x = _stack(frame["x"])
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])

    m = summed(train, moments, 1 + 2 * d)
    if not m[0]:
        return rows.select("doc_id", held_out.alias("held_out"), F.lit(0.5).alias("score"), *carry)
    mean = m[1 : 1 + d] / m[0]
    project = Projection(mean, np.sqrt(np.maximum(m[1 + d :] / m[0] - mean**2, 0)), components, gamma, seed)
    k = components + 1

    def equations(frame: pd.DataFrame) -> np.ndarray:
        z = project(_stack(frame["x"]))
        return np.concatenate([(z.T @ z).ravel(), z.T @ frame["y"].to_numpy()])

    s = summed(train, equations, k * k + k)
    weights = np.linalg.solve(s[: k * k].reshape(k, k) + ridge * np.eye(k), s[k * k :])

    def raw(x: np.ndarray) -> np.ndarray:
        return np.clip((project(x) @ weights - LOW) / (HIGH - LOW), 0, 1)

    def binned(frame: pd.DataFrame) -> np.ndarray:
        at = np.minimum((raw(_stack(frame["x"])) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, frame["y"].to_numpy(), BINS)])

    c = summed(train, binned, 2 * BINS)
    there = np.flatnonzero(c[:BINS])
    knots, values = isotonic((there + 0.5) / BINS, c[there], c[BINS + there])

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        at = np.concatenate([raw(_stack(x.iloc[low : low + 4096])) for low in range(0, len(x), 4096)])
        return pd.Series(np.clip(np.interp(at, knots, values) * 0.999 + at * 0.001, 0, 1))  # the last term orders ties

    return rows.select("doc_id", held_out.alias("held_out"), score("x").alias("score"), *carry)
