import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import automaton, phrases
from tests.llm.tables import CLASHES, SCHEMA, rows, table

UPPER = {c: c + 32 for c in range(65, 91)}


def plain_counts(docs, longest):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(len(words)):
                for d in range(1, min(longest, len(words) - k) + 1):
                    f[lang][tuple(words[k : k + d])] += 1
    return n, f


def plain(docs, longest, least, share, top):
    n, f = plain_counts(docs, longest)
    out = []
    for lang, counts in f.items():
        wide = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = defaultdict(int)
        for q, b in wide.items():
            for d in range(2, len(q)):
                for k in range(len(q) - d + 1):
                    held[q[k : k + d]] = max(held[q[k : k + d]], b)
        found = []
        for p, a in wide.items():
            if 100 * held[p] >= share * a:
                continue
            best = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-best[0], -a, " ".join(p).encode(), counts[p[: best[1]]], counts[p[best[1] :]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed=1, n=300):
    r = random.Random(seed)
    common = ["of", "the", "Of", "ÉTÉ", "été", "a-b", "x" * 50, "日本", "of the"]
    chain = ["one two three four five six", "two three four", "in the middle of the", "Of The"]
    docs = []
    for k in range(n):
        some = [r.choice(common) if r.random() < 0.6 else r.choice(chain) if r.random() < 0.7 else f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 40))]
        docs.append(("".join(x + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for x in some), r.choice(["en", "de", None, "und"])))
    return docs + [(None, "en"), ("", None), (" \t.;", "fr"), ("lonely", "fr")] + [docs[0]] * 5


def found(spark, docs, **settings):
    df = spark.createDataFrame([(k, t, lang, *["?"] * len(CLASHES)) for k, (t, lang) in enumerate(docs)], SCHEMA).repartition(3)
    return sorted(tuple(x) for x in phrases.collocations(df, **settings).collect())


@pytest.mark.parametrize(("longest", "least", "share", "top"), [(5, 4, 100, 2000), (3, 2, 80, 20), (2, 1, 100, 50), (5, 9, 100, 7)])
def test_against_plain(spark, longest, least, share, top):
    docs = corpus()
    got = found(spark, docs, longest=longest, least=least, share=share, top=top)
    assert got and got == plain(docs, longest, least, share, top)


def test_filled_cells_and_small_steps_change_nothing(spark, monkeypatch):
    """Cells that are all full cut nothing off; windows, shards and counting steps of a few words, and joins instead of broadcasts, give the same rows."""
    docs = corpus(2, 120)
    wanted = plain(docs, 5, 4, 100, 2000)
    monkeypatch.setattr(phrases, "SLICE", 8)
    assert found(spark, docs, least=4, bits=3) == wanted
    monkeypatch.undo()
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 0)
    assert found(spark, docs, least=4) == wanted


def test_windows_cut_nothing(monkeypatch):
    """A long text in windows of a few bytes has the words, pieces and contexts of the whole."""
    import pyarrow as pa

    text = " ".join(t for t, _ in corpus(3, 60) if t) + " " + "y" * 300 + " end of the text"
    batch = pa.RecordBatch.from_arrays([pa.array([text, "", "of the text"]), pa.array(["en", "en", "en"])], names=["text", "lang"])
    n, f = plain_counts([(text, "en"), ("of the text", "en")], 5)
    for width in (1 << 20, 64, 7):
        monkeypatch.setattr(phrases, "WINDOW", width)
        powers, shard, total = phrases.Powers(), phrases.Shard(), 0
        full = np.full(1 << 13, 255, np.uint8)
        for words, lang in phrases.windows(batch, powers, 5):
            total += len(words.start) - words.seen
            shard.add(words, phrases.reach(words, full, 16, 5), lang)
        got = Counter()
        for out, _ in shard.phrases(5):
            for p, c in zip(out.column("phrase").to_pylist(), out.column("n").to_pylist(), strict=True):
                got[tuple(p.split(" "))] += c
        got.pop(("",), None)
        assert total == n["en"] and got == Counter(f["en"])


def test_blocks_fold_to_the_same_counts(spark):
    """Many shards' blocks in few buckets, folded after every block, give the sums of all."""
    import pyarrow as pa

    docs = corpus(4, 90)
    n, f = plain_counts(docs[:-9], 5)
    rows = []
    for k in range(0, len(docs) - 9, 10):
        batch = pa.RecordBatch.from_pylist([{"text": t or "", "lang": lang or "und"} for t, lang in docs[k : min(k + 10, len(docs) - 9)]])
        shard = phrases.Shard()
        for words, lang in phrases.windows(batch, phrases.Powers(), 5):
            shard.count(words, lang)
            shard.add(words, phrases.reach(words, np.full(1 << 13, 255, np.uint8), 16, 5), lang)
        rows += [x for b in shard.blocks(5, 3) for x in b.to_pylist()]
    assert {x["bucket"] for x in rows} == {0, 1, 2}
    blocks = spark.createDataFrame([(x["bucket"], bytearray(x["block"])) for x in rows], "bucket int, block binary").repartition(2, "bucket").sortWithinPartitions("bucket")
    got = {(x["lang"], x["phrase"]): x["n"] for x in phrases.added(blocks, 3).collect()}
    assert got == {(lang, " ".join(p)): c for lang in f for p, c in f[lang].items() if c >= 3} | {(lang, ""): c for lang, c in n.items() if c}


def test_odd_rows_and_empty_table(spark):
    docs = [(t, "xx") for _, t in rows()]
    got = sorted(tuple(x) for x in phrases.collocations(table(spark, rows()), least=3).collect())
    assert got and got == plain(docs, 5, 3, 100, 2000)
    assert phrases.collocations(table(spark, [])).collect() == []


def test_scores_past_64_bits(spark):
    r = random.Random(1)
    some = [(a := r.randint(100, 10**12), r.randint(a, 10**13), r.randint(a, 10**13), r.randint(10**13, 10**15)) for _ in range(300)]
    df = spark.createDataFrame(some, "a long, l long, r long, n long")
    for x in df.select("*", phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect():
        assert x["s"] == 1000 * x["a"] * x["n"] // (x["l"] * x["r"])


def online(sequence):
    """The states of the suffix automaton made letter by letter, as {(longest substring, ends)}."""
    length, link, steps, ends = [0], [-1], [{}], [0]
    last = 0
    for c in sequence:
        new = len(length)
        length.append(length[last] + 1), link.append(0), steps.append({}), ends.append(1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] != length[p] + 1:
                clone = len(length)
                length.append(length[p] + 1), link.append(link[q]), steps.append(dict(steps[q])), ends.append(0)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        last = new
    for s in sorted(range(1, len(length)), key=lambda s: -length[s]):
        ends[link[s]] += ends[s]
    return Counter((length[s], length[link[s]], ends[s]) for s in range(1, len(length)))


def test_states_are_those_of_the_online_construction():
    r = random.Random(8)
    for n in (1, 2, 7, 60, 200):
        for letters in (1, 2, 4):
            sequence = [r.randrange(letters) for _ in range(n)]
            got = automaton.build(np.array(sequence), np.arange(1, n + 1), n)
            above = np.where(got.link >= 0, got.length[got.link], 0)
            assert Counter(zip(got.length.tolist(), above.tolist(), got.count.tolist(), strict=True)) == online(sequence)
