import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import packing
from tests.llm.tables import rows, table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    size = r.choice((1, 7, 64, 300))
    counts = Counter(r.randint(1, size) if seed % 2 else min(size, int(r.expovariate(8 / size)) + 1) for _ in range(r.choice((1, 50, 3000))))
    sequences, seen = defaultdict(list), Counter()
    for length, first, n, each, sequence, place in packing.packing_plan(counts, size):
        assert first == seen[length]
        seen[length] += n
        for k in range(n):
            sequences[sequence + k // each].append((place + k % each * length, length))
    assert seen == counts
    for parts in sequences.values():
        at = 0
        for place, length in sorted(parts):
            assert place == at
            at += length
        assert at <= size
    least = -(-sum(k * n for k, n in counts.items()) // size)
    assert len(sequences) <= max(least + 2, 1.25 * least)


def test_index_of_sums():
    """Singles, pairs and triples by their sum, against all combinations, while counts go down."""
    import itertools

    r = random.Random(3)
    for _ in range(30):
        counts = np.zeros(25, np.int64)
        for _ in range(r.randint(0, 30)):
            counts[r.randint(1, 24)] += r.randint(1, 2)
        index = packing.SumIndex(counts)
        while True:
            lengths = np.flatnonzero(index.left).tolist()
            for total in range(1, 25):
                ways = {k: {tuple(sorted(c, reverse=True)) for c in itertools.combinations_with_replacement(lengths, k) if sum(c) == total and all(index.left[x] >= c.count(x) for x in c)} for k in (1, 2)}
                assert index.single(total) == bool(ways[1]) and index.pairs(total) == sorted(ways[2], reverse=True) and index.pair_count[total] == len(ways[2])
                triples = {tuple(sorted(c, reverse=True)) for c in itertools.combinations_with_replacement(lengths, 3) if sum(c) == total and all(index.left[x] >= c.count(x) for x in c)}
                assert triples <= set(index.triples(total))  # those that need a length oftener than it is left are told by the counts
            if not lengths:
                break
            gone = r.choice(lengths)
            index.take(gone, r.randint(1, int(index.left[gone])))


def test_plan_fills_exactly():
    assert len({r[4] for r in packing.packing_plan({60: 1, 40: 1, 50: 1, 30: 1, 20: 1, 70: 1, 15: 2}, 100)}) == 3


def test_pack(spark):
    docs = [*rows(), (82, "hello <|endoftext|> world"), (83, "<|startoftext|>é <|ENDOFTEXT|> <|endoftext|><|endoftext|>")]
    found = packing.pack(table(spark, docs), PATH, max_len=256, carry={"ids_crc32": F.crc32("ids")}).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 256):
            part = ids[start : start + 256]
            expected[doc_id, start // 256, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in found) == expected
    assert next(x["length"] for x in found if x["doc_id"] == 82) == 4  # the contract's plain call gives a literal token its own id: three ids and the end id
    places = defaultdict(list)
    for x in found:
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_pack_carries_ids_and_takes_empty_tables(spark):
    assert packing.pack(table(spark, []), PATH).collect() == []
    one = packing.pack(table(spark, [(1, "hello hello")]), PATH).first()
    assert len(one["ids"]) == 4 * one["length"] and one["offset"] == 0


def test_rows_alike_take_places_apart(spark):
    """Thousands of empty texts under a null id: every piece has a place of its own, and none is lost."""
    docs = [(None, "")] * 5000 + [(k, f"text {k}") for k in range(50)]
    found = packing.pack(table(spark, docs), public_tokenizers.path("word_bpe_49k.json"), carry={}).collect()
    at = {(x["sequence_id"], x["offset"]) for x in found}
    assert len(found) == len(at) == 5050 and sum(x["length"] for x in found) <= 2048 * len({s for s, _ in at})
