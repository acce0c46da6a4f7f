import zlib
from collections import Counter, defaultdict

from millrace.llm import sharding
from tests.llm.tables import rows, table


def test_shards(spark):
    docs = rows() * 1
    found = sharding.byte_shards(table(spark, docs), 5).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in found) == Counter((d, len(raw(t)) + 16, zlib.crc32(raw(t))) for d, t in docs)
    by = defaultdict(list)
    for x in found:
        by[x["shard"]].append(x)
    for some in by.values():
        assert sorted(x["slot"] for x in some) == list(range(len(some)))
    total, largest = sum(x["size"] for x in found), max(x["size"] for x in found)
    assert all(abs(sum(x["size"] for x in some) - total / 5) <= 2 * largest for some in by.values())


def test_near_equal_and_few_groups_cut(spark):
    docs = [(k, f"text {k % 700} " * 9) for k in range(6000)] + [(10_000 + k, "hot " * 30) for k in range(3000)]
    found = sharding.byte_shards(table(spark, docs), 8).collect()
    sizes, shards = Counter(), defaultdict(set)
    text = dict(docs)
    for x in found:
        sizes[x["shard"]] += x["size"]
        shards[text[x["doc_id"]]].add(x["shard"])
    mean = sum(sizes.values()) / 8
    assert set(sizes) == set(range(8)) and all(abs(s - mean) < 0.02 * mean for s in sizes.values())
    assert sum(len(s) > 1 for s in shards.values()) <= 8


def test_rows_alike_lie_in_many_partitions(spark):
    """Rows of one text without a doc_id are told apart by their places: they are dealt to many partitions, and shards stay equal."""
    found = sharding.byte_shards(table(spark, [(None, "")] * 4000 + [(k, f"text {k}") for k in range(500)]), 10, parts=8).collect()
    sizes, slots = Counter(), defaultdict(list)
    for x in found:
        sizes[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    assert len(found) == 4500 and max(sizes.values()) - min(sizes.values()) <= 2 * max(x["size"] for x in found)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table(spark):
    assert sharding.byte_shards(table(spark, []), 4).collect() == []
