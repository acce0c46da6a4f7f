"""Trees, nested digests, chains and random numbers on small tables, against plain Python."""

import datetime
import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import nested, randomness
from millrace.operators import chains, merkle

ROWS = "k long, text string"


def corpus(seed=1, n=200):
    r = random.Random(seed)
    out = [(r.randint(-60, 900), r.choice(["", None, "a", "bé", "c" * 40, str(r.random())])) for _ in range(n)]
    return out + [(None, "x"), (None, None), (5, "twice"), (5, "twice")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(rows, width, arity):
    """The root, by the definition: digests in cells, cells in stretches, stretches in nodes."""
    counts = {}
    for k, text in rows:
        d = sha(("null" if k is None else str(k)) + ("!" if text is None else ":" + text))
        cell = counts.setdefault(None if k is None else k // width, {}).setdefault(d[:4], {})
        cell[d] = cell.get(d, 0) + 1
    cells = {s: {c: sha("c" + ",".join(f"{d}={n}" for d, n in sorted(ds.items()))) for c, ds in cs.items()} for s, cs in counts.items()}
    level = {s: sha("s" + ",".join(f"{c}={d}" for c, d in sorted(cs.items()))) for s, cs in cells.items()}
    joined = lambda kind, nodes: sha(kind + ",".join(d if k is None else f"{k}={d}" for k, d in sorted(nodes.items(), key=lambda x: (x[0] is not None, x[0] or 0))))
    while any(k not in (-1, 0, None) for k in level):
        above = {}
        for k, d in level.items():
            above.setdefault(None if k is None else k // arity, {})[k] = d
        level = {k: joined("n", nodes) for k, nodes in above.items()}
    return joined("r", level)


def test_one_root_for_any_partitions(spark):
    rows = corpus()
    for parts in (1, 3, 7):
        some = random.Random(parts).sample(rows, len(rows))
        nodes = merkle.tree(spark.createDataFrame(some, ROWS).repartition(parts), "k", "text", 10, 4)
        assert merkle.root(nodes) == plain_root(rows, 10, 4)
        assert {x["n"] for x in nodes.groupBy("level").agg(F.sum("n").alias("n")).collect()} == {len(rows)}
    changed = [*rows[:-1], (5, "twice!")]
    for other in (changed, rows[:-1], [*rows, (None, None)], [(k, "" if t is None else t) for k, t in rows]):
        assert merkle.root(merkle.tree(spark.createDataFrame(other, ROWS), "k", "text", 10, 4)) == plain_root(other, 10, 4) != plain_root(rows, 10, 4)


def test_changes_are_found_by_going_down(spark):
    rows = [(k, f"text {k}") for k in range(0, 800, 3)]
    other = [(k, t + "!" if k == 300 else t) for k, t in rows if k not in (33, 36, 39)] + [(799, "new"), (31, "between"), (5000, "far"), (-3, "before"), (None, "none")]
    old, new = (merkle.tree(spark.createDataFrame(x, ROWS), "k", "text", 10, 4) for x in (rows, other))
    found = {(x["node"], x["change"]) for x in merkle.changes(old, new, 4).collect()}
    assert found == {(30, "changed"), (3, "changed"), (79, "changed"), (500, "added"), (-1, "added"), (None, "added")}
    assert {(x["node"], x["change"]) for x in merkle.changes(new, old, 4).collect()} == {(n, {"added": "removed"}.get(c, c)) for n, c in found}
    assert merkle.changes(old, old, 4).collect() == []


def test_a_stretch_is_proved(spark):
    rows = [(k, f"text {k}") for k in range(0, 3000, 7)]
    nodes = merkle.tree(spark.createDataFrame(rows, ROWS), "k", "text", 10, 4)
    for stretch in (0, 77, 299):
        told = merkle.proof(nodes, stretch, 4)
        own = next(x["sha256"] for x in told if x["level"] == 0 and x["node"] == stretch)
        assert len(told) <= 6 * 4 and merkle.proved(told, stretch, own, 4) == merkle.root(nodes)
        assert merkle.proved(told, stretch, sha("other"), 4) is None
        told[-2]["sha256"] = sha("forged")
        assert merkle.proved(told, stretch, own, 4) != merkle.root(nodes)


def test_a_key_of_most_rows_and_no_rows(spark):
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("k"), F.col("id").cast("string").alias("text"))
    assert merkle.root(merkle.tree(hot, "k", "text")) == plain_root([(7, str(k)) for k in range(3000)], 1000, 64)
    empty = merkle.tree(hot.limit(0), "k", "text")
    assert [(x["n"], x["sha256"]) for x in empty.collect()] == [(0, sha("r"))]


KIND = "struct<i: int, names: array<string>, deep: array<struct<x: double, m: map<string, array<bigint>>>>, raw: binary, at: timestamp, d: date, money: decimal(10,2), ok: boolean>"
VALUE = {"i": 1, "names": ["a", None, ""], "deep": [{"x": 0.5, "m": {"k": [1, 2], "e": []}}, None, {"x": None, "m": None}], "raw": bytearray(b"\x00\xff"), "at": datetime.datetime(2024, 1, 2, 3, 4, 5), "d": datetime.date(2024, 1, 2), "money": Decimal("1.50"), "ok": True}


def digests(spark, values, kind=KIND):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"n int, v {kind}")
    return [x["s"] for x in df.select("n", nested.digest(F.col("v"), df.schema["v"].dataType).alias("s")).orderBy("n").collect()]


def test_every_change_of_a_nested_value_shows(spark):
    def changed(**with_):
        return VALUE | with_

    deep = VALUE["deep"]
    others = [changed(i=2), changed(i=None), changed(names=["a", ""]), changed(names=["", None, "a"]), changed(names=["a", None]), changed(names=[]), changed(names=None), changed(names=["a", None, "", None])]
    others += [changed(deep=deep[:2]), changed(deep=[deep[0], deep[2], None]), changed(deep=[{"x": 0.5, "m": {"k": [2, 1], "e": []}}, None, deep[2]]), changed(deep=[{"x": 0.5, "m": {"k": [1, 2]}}, None, deep[2]]), changed(deep=[{"x": -0.5, "m": deep[0]["m"]}, None, deep[2]])]
    others += [changed(raw=bytearray(b"\x00\xfe")), changed(at=datetime.datetime(2024, 1, 2, 3, 4, 6)), changed(d=None), changed(money=Decimal("1.51")), changed(ok=False), None]
    found = digests(spark, [VALUE, *others, changed(deep=[{"x": 0.5, "m": {"e": [], "k": [1, 2]}}, None, deep[2]])])
    assert len(set(found)) == 1 + len(others) and found[-1] == found[0] and all(len(x) == 64 for x in found)


def test_types_names_and_order_count(spark):
    one = {kind: digests(spark, [v], kind)[0] for kind, v in (("int", 1), ("bigint", 1), ("smallint", 1), ("string", "1"), ("array<int>", [1]), ("array<bigint>", [1]), ("binary", bytearray(b"1")), ("double", 1.0), ("boolean", True), ("struct<a: int>", {"a": 1}), ("struct<b: int>", {"b": 1}), ("struct<a: int, b: int>", {"a": 1, "b": None}), ("struct<b: int, a: int>", {"a": 1, "b": None}), ("map<string, int>", {"a": 1}))}
    none = {kind: digests(spark, [None], kind)[0] for kind in ("int", "string", "array<int>", "struct<a: int>", "map<string, int>")}
    assert len({*one.values(), *none.values()}) == len(one) + len(none)
    assert one["int"] == sha("int:1") and none["string"] == sha("null:string") and one["array<int>"] == sha("array:" + sha("int:1"))
    with pytest.raises(TypeError, match="no digest"):
        nested.digest(F.lit(1), T.NullType())
    rows = spark.createDataFrame([(1, "a")], "x int, y string")
    assert nested.with_digest(rows).first()["sha256"] == nested.with_digest(rows, columns=["x", "y"]).first()["sha256"] != nested.with_digest(rows.select("y", "x")).first()["sha256"]


def plain_verdict(own, links, name):
    """(length, problems, first problem) by following all ways."""
    longest, found, ways = 0, [], [(name, (name,))]
    while ways:
        at, path = ways.pop()
        for other, recorded in links.get(at, []):
            longest = max(longest, len(path))
            problem = "missing" if other not in own else "changed" if own[other] != recorded else "cycle" if other in path else None
            if problem:
                found.append((len(path), f"{at} -> {other}", problem))
            else:
                ways.append((other, (*path, other)))
    return (longest, len(found), *(min(found) if found else (None, None, None)))


def test_chains(spark):
    r = random.Random(2)
    own = {f"r{k}": f"h{k}" for k in range(60)}
    links = {}
    for k in range(60):
        for other in sorted({r.randint(0, 60) for _ in range(r.choice([0, 1, 1, 1, 2]))}):
            if other < k or r.random() < 0.2:
                links.setdefault(f"r{k}", []).append((f"r{other}", f"h{other}" if r.random() < 0.9 else "old"))
    links["r7"], links["r3"], links["r9"] = [("r60", "h60")], [("r9", "h9")], [("r3", "h3"), ("r1", "h1")]
    records = spark.createDataFrame(list(own.items()), "name string, sha256 string")
    listed = spark.createDataFrame([(a, b, h) for a, some in links.items() for b, h in some], "name string, other string, sha256 string")
    found = {x["name"]: tuple(x)[1:] for x in chains.verdicts(records, listed).collect()}
    assert found == {name: plain_verdict(own, links, name) for name in own}
    assert {v[4] for v in found.values()} == {None, "missing", "changed", "cycle"}


def test_data_tokenizer_freeze_challenge(spark):
    records = spark.createDataFrame([("data", "1"), ("tokenizer", "2"), ("freeze", "3"), ("challenge", "4")], "name string, sha256 string")
    whole = [("tokenizer", "data", "1"), ("freeze", "data", "1"), ("freeze", "tokenizer", "2"), ("challenge", "freeze", "3")]
    schema = "name string, other string, sha256 string"
    assert all(x["problem"] is None for x in chains.verdicts(records, spark.createDataFrame(whole, schema)).collect())
    broken = spark.createDataFrame([("tokenizer", "data", "0"), *whole[1:]], schema)
    found = {x["name"]: (x["problem"], x["link"], x["depth"]) for x in chains.verdicts(records, broken).collect()}
    assert found == {"data": (None, None, None), "tokenizer": ("changed", "tokenizer -> data", 1), "freeze": ("changed", "tokenizer -> data", 2), "challenge": ("changed", "tokenizer -> data", 3)}
    line = spark.createDataFrame([(f"r{k}", "h") for k in range(30)], "name string, sha256 string")
    steps = spark.createDataFrame([(f"r{k}", f"r{k + 1}", "h") for k in range(29)], schema)
    assert chains.verdicts(line, steps).agg(F.max("length")).first()[0] == 29
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        chains.verdicts(line, steps, longest=10).collect()


def test_draws_go_on_after_a_restart(spark):
    df = spark.createDataFrame([(k * 3,) for k in range(100)], "k long")
    draws = lambda rows: {x["k"]: (x["u"], x["n"]) for x in rows.select("k", randomness.uniform(7, "a", F.col("counter")).alias("u"), randomness.normal(7, "a", F.col("counter")).alias("n")).collect()}
    whole, state = randomness.numbered(df, randomness.Streams(7), "a", "k")
    assert state.counters == {"a": 100}
    first, half = randomness.numbered(df.filter("k < 120"), randomness.Streams(7), "a", "k")
    again, end = randomness.numbered(df.filter("k >= 120").repartition(5), randomness.Streams.restored(half.advanced("b", 3).saved(), 7), "a", "k")
    assert draws(first) | draws(again) == draws(whole) and end.counters == {"a": 100, "b": 3}
    with pytest.raises(ValueError, match="seed"):
        randomness.Streams.restored(half.saved(), 8)
    for odd in ({"version": 2, "seed": 7, "counters": {}}, {"version": 1, "seed": 7, "counters": {"a": -1}}):
        with pytest.raises(ValueError, match="seed"):
            randomness.Streams.restored(json.dumps(odd), 7)


def test_draws_are_spread_and_apart(spark):
    rows = spark.range(20_000).select(*[randomness.uniform(s, stream, F.col("id"), lane).alias(name) for name, s, stream, lane in (("a", 1, "x", 0), ("b", 1, "y", 0), ("c", 2, "x", 0), ("d", 1, "x", 1))], randomness.below(1, "x", F.col("id"), 10).alias("die"), randomness.normal(1, "x", F.col("id")).alias("z"))
    found = rows.agg(*[F.avg(c).alias(c) for c in "abcd"], *[F.corr("a", c).alias(f"a{c}") for c in "bcd"], F.min("a").alias("low"), F.max("a").alias("high"), F.avg("z").alias("mean"), F.stddev("z").alias("sd")).first()
    assert all(abs(found[c] - 0.5) < 0.01 for c in "abcd") and all(abs(found[f"a{c}"]) < 0.03 for c in "bcd") and 0 <= found["low"] < 0.001 and 0.999 < found["high"] < 1
    assert abs(found["mean"]) < 0.03 and abs(found["sd"] - 1) < 0.03
    assert {x["die"]: abs(x["count"] - 2000) < 200 for x in rows.groupBy("die").count().collect()} == dict.fromkeys(range(10), True)
    with pytest.raises(ValueError, match="n must"):
        randomness.below(1, "x", F.lit(1), 0)
