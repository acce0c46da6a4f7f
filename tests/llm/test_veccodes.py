import random
from collections import defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from millrace.llm import veccodes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("codes", "error", "vector", "name", "hot", "part", "n")]])


def table(spark, some):
    return spark.createDataFrame([(i, v, label, *["?"] * 7) for i, v, label in some], SCHEMA)


def plain(some, parts, entries, rounds):
    """(vec_id, codes, error, label_error) of the kept rows, sorted, and the codebooks, in Python's whole numbers."""
    from fractions import Fraction

    good = [(i, v, label) for i, v, label in some if v and all(x is not None and abs(x) < float("inf") for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[floor(Fraction(x) * 1024) for x in v] for _, v, _ in good]
    width = len(whole[0]) // parts if whole else 0
    cut = [[w[k * width : (k + 1) * width] for w in whole] for k in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda k: [min((far(x, b), e) for e, b in enumerate(books[k])) for x in cut[k]]
    for _ in range(rounds):
        for k in range(parts):
            members = defaultdict(list)
            for x, (_, e) in zip(cut[k], assign(k), strict=True):
                members[e].append(x)
            for e, xs in members.items():
                books[k][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    last = [assign(k) for k in range(parts)]
    errors = [sum(last[k][r][0] for k in range(parts)) for r in range(len(good))]
    by = defaultdict(int)
    for (_, _, label), e in zip(good, errors, strict=True):
        by[label] += e
    return sorted(((i, [last[k][r][1] for k in range(parts)], e if e < 2**63 else None, by[label] if by[label] < 2**63 else None) for r, ((i, _, label), e) in enumerate(zip(good, errors, strict=True))), key=repr), books


def vectors(n, dims, seed=1, spread=1.0):
    r = random.Random(seed)
    out = [(k * 3 % n, [round(r.gauss(0, spread), 2) for _ in range(dims)], r.choice([None, 0, 1, 2])) for k in range(n)]
    return out + [(n + 1, out[0][1], 1), (n + 1, out[0][1], 1), (n + 1, out[1][1], None), (None, out[2][1], 2), (n + 2, None, 1), (n + 3, [], 1), (n + 4, [None, *out[0][1][1:]], 1), (n + 5, [float("nan"), *out[0][1][1:]], 1), (-1, [float("-inf"), *out[0][1][1:]], 1)]


def check(spark, some, parts, entries, rounds):
    coded, books = veccodes.compress(table(spark, some), "embedding", parts, entries, rounds)
    rows, wanted = plain(some, parts, entries, rounds)
    assert [[[int(v) for v in e] for e in b] for b in books] == wanted
    assert sorted(((x["vec_id"], x["codes"], x["error"], x["label_error"]) for x in coded.collect()), key=repr) == rows


def test_against_plain(spark):
    check(spark, vectors(150, 8), 4, 16, 4)


def test_ties_and_unused_entries(spark):
    """Vectors on a coarse grid: most distances are equal to others, and entries are equal to each other."""
    r = random.Random(4)
    some = [(k, [float(r.randint(0, 1)) for _ in range(4)], k % 2) for k in range(80)]
    check(spark, some, 2, 32, 3)


def test_large_components(spark):
    """Squares beyond 2^53, sums beyond 2^64, errors beyond 2^63."""
    r = random.Random(6)
    some = [(k, [r.choice([1e3, 1e9, 1e15, -3e38, 1e300, 0.3]) * r.random() for _ in range(4)], k % 3) for k in range(60)]
    check(spark, some, 2, 8, 2)
    check(spark, [(k, [r.uniform(-4e6, 4e6) for _ in range(4)], k % 3) for k in range(60)], 2, 8, 2)


def test_fewer_rows_than_entries_and_none(spark):
    check(spark, vectors(5, 4), 4, 256, 2)
    coded, books = veccodes.compress(table(spark, []))
    assert coded.collect() == [] and all(not len(b) for b in books)
    assert coded.schema.simpleString() == veccodes.compress(table(spark, vectors(5, 4)))[0].schema.simpleString()


def test_lengths_must_agree(spark):
    with pytest.raises(ValueError, match="length"):
        veccodes.compress(table(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)]))
    with pytest.raises(ValueError, match="length"):
        veccodes.compress(table(spark, [(1, [1.0] * 5, 1)]))


def test_search_looks_at_a_part_of_the_entries_and_misses_none():
    r = np.random.default_rng(2)
    centres = np.floor(r.normal(0, 400, (256, 16)))
    points = centres[r.integers(0, 256, 3000)] + np.floor(r.normal(0, 40, (3000, 16)))
    tool = veccodes.Entries(centres)
    true = veccodes.distances(points, centres)
    codes, found = tool.nearest(points, np.zeros(len(points), np.int64))
    assert (codes == true.argmin(axis=1)).all() and (found == true.min(axis=1)).all()
    tool.looked = 0
    again, _ = tool.nearest(points, codes)
    assert (again == codes).all() and tool.looked < 0.2 * true.size


def test_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(veccodes, "HOT_ROWS", 1)
    monkeypatch.setattr(veccodes, "HOT_SHARE", 3)
    check(spark, vectors(60, 4), 2, 8, 1)


def test_query_against_plain(spark):
    small = "/root/testdata/sf0.001"
    some = [tuple(x) for x in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>"), "label").limit(10_000).collect()]
    rows, books = plain(some[:300], 4, 256, 1)
    coded, found = veccodes.compress(table(spark, some[:300]), rounds=1)
    assert sorted(((x["vec_id"], x["codes"], x["error"], x["label_error"]) for x in coded.collect()), key=repr) == rows
    out = __spark_entry__.queries()["op12_vector_codes"](spark, small).collect()
    assert len(out) == len(some) and all(len(x["code"]) == 8 for x in out) and len({x["codebooks_sha256"] for x in out}) == 1
