import random
import re
from collections import Counter

import pytest

from millrace.llm import graph, jaccard
from tests.llm.tables import rows, table, words


def brute(docs, threshold=0.8):
    sets = []
    for _, text in docs:
        w = [x for x in re.split("[ \t\n\r\x0b\x0c]+", (text or "").lower()) if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n, head, links = len(docs), list(range(len(docs))), [0] * len(docs)

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    for i in range(n):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common and common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                head[find(i)] = find(j)
    least = {}
    for k in range(n):
        if docs[k][0] is not None:
            least[find(k)] = min(least.get(find(k), docs[k][0]), docs[k][0])
    return Counter((docs[k][0], least.get(find(k)), links[k]) for k in range(n))


@pytest.mark.parametrize("block", [512, 3])
def test_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", block)
    r = random.Random(6)
    docs = rows()
    for g in range(6):
        base = words(r, 150).split(" ")
        for k in range(9):
            some = list(base)
            for _ in range(r.randint(0, 5)):
                some[r.randrange(len(some))] = "changed"
            docs.append((1000 + 20 * g + k, " ".join(some)))
    found = jaccard.jaccard_join(table(spark, docs)).collect()
    assert Counter((x["doc_id"], x["class_id"], x["n_links"]) for x in found) == brute(docs)


def test_large_group_in_one_task(spark):
    r = random.Random(7)
    base = words(r, 100).split(" ")
    docs = []
    for k in range(150):
        some = list(base)
        some[r.randrange(100)] = f"w{k}"
        docs.append((k, " ".join(some)))
    found = jaccard.jaccard_join(table(spark, docs)).collect()
    assert Counter((x["doc_id"], x["class_id"], x["n_links"]) for x in found) == brute(docs)


def test_many_rows_of_one_id(spark):
    """A thousand rows of one doc_id and a thousand without: texts are found by row, not by id."""
    r = random.Random(9)
    base = words(r, 60).split(" ")

    def near(k: int) -> str:
        return " ".join([*base[:30], f"w{k % 40}", *base[31:]])

    docs = [(5 if k % 2 else None, near(k) if k % 10 == 0 else words(random.Random(k), 12)) for k in range(2000)] + [(7, near(1)), (8, near(2))]
    found = jaccard.jaccard_join(table(spark, docs)).collect()
    assert Counter((x["doc_id"], x["class_id"], x["n_links"]) for x in found) == brute(docs)


def test_least_matches():
    assert jaccard.least_matches(128, 0.8, 1e-7) < 102 and jaccard.least_matches(32, 0.8, 1e-7) > 5


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + r.randint(0, 30), 100 + r.randint(0, 30)) for _ in range(25)]
    found = {x["id"]: x["label"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    head = {k: k for e in edges for k in e}

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    for a, b in edges:
        head[max(find(a), find(b))] = min(find(a), find(b))
    assert found == {k: find(k) for a, b in edges if a != b for k in (a, b)}


def test_empty_table(spark):
    assert jaccard.jaccard_join(table(spark, [])).collect() == []
