import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import substrings, suffix
from tests.llm.tables import rows, table


def brute(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8), [0]])))
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), tuple(map(tuple, edges.reshape(-1, 2).tolist()))))
    return out


def brute_passages(texts, n):
    """Maximal stretches of words in strings of n words that also start elsewhere, as bytes of each text."""
    found = [[m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", t)] for t in texts]
    strings = [[tuple(t[a:b] for a, b in w[k : k + n]) for k in range(len(w) - n + 1)] for t, w in zip(texts, found, strict=True)]
    seen = Counter(s for some in strings for s in some)
    out = []
    for w, some in zip(found, strings, strict=True):
        gone = bytearray(len(w))
        for k, s in enumerate(some):
            if seen[s] > 1:
                gone[k : k + n] = b"\1" * n
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(bytes(gone), np.uint8), [0]]))).reshape(-1, 2)
        out.append(tuple((w[a][0], w[b - 1][1]) for a, b in edges.tolist()))
    return out


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(0)
    for k in range(250):
        text = r.integers(1, r.integers(2, 6), r.integers(1, 200))
        if k % 5 == 0:
            text = np.tile(text[: max(1, len(text) // 5)], 6)
        text = np.append(text, 0)
        raw = text.astype(np.uint8).tobytes()
        sa = suffix.suffix_array(text)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        previous, shared = suffix.permuted_prefixes(text, sa, 20)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            same = 0
            while max(a, b) + same < len(raw) and raw[a + same] == raw[b + same]:
                same += 1
            assert previous[b] == a and min(shared[b], 20) == min(same, 20)


@pytest.mark.parametrize("kinds", [300, 5000, 100_000])
def test_large_alphabets(kinds):
    """Prefixes of values that don't fit in a byte: repeats of a few stretches, and values that differ in high bits only."""
    r = np.random.default_rng(kinds)
    some = [r.integers(1, kinds, 40) for _ in range(5)] + [np.array([1, 257, 1, 513, 257, 256, 1, 512]) % kinds + 1]
    text = np.concatenate([some[k] for k in r.integers(0, 6, 60)])
    text = np.append(np.unique(text, return_inverse=True)[1] * (kinds // 300) + 1, 0)
    sa = suffix.suffix_array(text)
    values = text.tolist()
    assert sa.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
    previous, shared = suffix.permuted_prefixes(text, sa, 60)
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        same = 0
        while max(a, b) + same < len(values) and values[a + same] == values[b + same]:
            same += 1
        assert previous[b] == a and min(shared[b], 60) == min(same, 60)


def test_long_run_of_one_letter():
    assert suffix.suffix_array(np.append(np.ones(3000, np.int64), 0)).tolist() == list(range(3000, -1, -1))


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("length,gram,words,word_gram", [(40, 16, 6, 2), (400, 128, 51, 16), (60, 8, 12, 3)])
def test_against_brute_force(spark, monkeypatch, hot, length, gram, words, word_gram):
    monkeypatch.setattr(substrings, "HOT", hot)
    r = random.Random(8)
    docs = rows()
    line = "a very common line of words that all have, end"
    docs += [(100 + k, f"{r.random()} {line} {r.random()} {line[:30]}{k}") for k in range(12)] + [(200, "ab" * 300), (201, "ab" * 260 + "c"), (202, "z\x00" * 50 + "q" * 90), (203, "\x00z" * 50)]
    texts = [(t or "").encode() for _, t in docs]
    expected = Counter((d, len(t), spans, kept) for (d, _), t, (kept, spans) in zip(docs, texts, brute(texts, length), strict=True))
    found = substrings.remove_repeats(table(spark, docs), length, gram, words, word_gram).collect()
    assert Counter((x["doc_id"], x["n_bytes"], tuple((s["start"], s["end"]) for s in x["spans"]), bytes(x["kept"])) for x in found) == expected
    passages = brute_passages(texts, words)
    assert Counter((x["doc_id"], tuple((s["start"], s["end"]) for s in x["passages"])) for x in found) == Counter((d, p) for (d, _), p in zip(docs, passages, strict=True))
    assert any(passages)


def test_empty_table(spark):
    assert substrings.remove_repeats(table(spark, [])).collect() == []


def test_planted_passages_and_clean_documents(spark):
    """Passages of 51 to 90 words, of fewer and of more than 400 bytes, in two documents each, and documents without any: n_bytes tells nothing of them,
    n_removed only passages of 400 bytes, n_passages all."""
    r = random.Random(3)
    planted = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.choice(size))) for _ in range(n)) for n, size in ((51, (2, 5)), (55, (3, 6)), (60, (5, 8)), (90, (6, 8)), (52, (9,)))]
    fresh = lambda n: " ".join(f"{r.getrandbits(40):x}" for _ in range(n))
    docs = [(10 * k + j, f"{fresh(40)}{gap}{p}{gap}{fresh(30)}") for k, p in enumerate(planted) for j, gap in enumerate((" ", "\n"))] + [(1000 + k, fresh(150)) for k in range(20)]
    found = {x["doc_id"]: x for x in substrings.remove_repeats(table(spark, docs)).collect()}
    assert all((len(found[d]["passages"]) == 1) == (d < 1000) for d, _ in docs)
    for k, p in enumerate(planted):
        for j in range(2):
            s = found[10 * k + j]["passages"][0]
            assert dict(docs)[10 * k + j][s["start"] : s["end"]] == p
            assert (len(found[10 * k + j]["spans"]) > 0) == (len(p) >= 400)
    assert {len(p) >= 400 for p in planted} == {True, False}


def test_rows_of_joined_tables(spark, tmp_path):
    """Exploded rows, unions of a table with itself, and columns named like the operator's own."""
    long = "a text of many bytes and words that comes again " * 12
    spark.createDataFrame([(1, long, "x", "y"), (2, "short", "x", "y")], "doc_id long, text string, _place string, _metadata string").write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    for some, n in ((docs, 1), (docs.unionByName(docs), 2), (docs.withColumn("e", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))), 3)):
        found = substrings.remove_repeats(some).collect()
        assert Counter(x["doc_id"] for x in found) == {1: n, 2: n}
        assert all(len(x["kept"]) == 0 for x in found if x["doc_id"] == 1)
