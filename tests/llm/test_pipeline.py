from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import pii, quality
from tests.llm.tables import SCHEMA, rows, table
from tests.llm.test_jaccard import brute

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SMALL)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({x["doc_id"]: x["text"] for x in docs.collect()})
    everything = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    scores = quality.classify(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    good = {x["doc_id"] for x in scores.filter(F.col("score") >= quality.THRESHOLD).collect()}
    assert kept[0] == {d: t for d, t in everything.items() if d in good} and 0 < len(good) < len(everything)
    last = {}
    for d, t in kept[0].items():
        last[t] = max(d, last.get(t, d))
    assert kept[1] == {d: t for t, d in last.items()}
    heads = {d: h for d, h, _ in brute(list(kept[1].items()))}
    assert kept[2] == {d: t for d, t in kept[1].items() if heads[d] == d}
    assert kept[3] == {d: pii.masked(t, pii.all_spans(t, pii.fitted())[1]) for d, t in kept[2].items()}
    assert all(not pii.base_spans(t) for t in kept[3].values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for t in kept[3].values():
        lengths[len(tokenizer.encode(t, add_special_tokens=False).ids) + 1] += 1
    packed = defaultdict(int)
    for x in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect():
        packed[x["doc_id"]] += x["length"]
    assert Counter(packed.values()) == lengths
    assert corpus_pipeline.run(spark, SMALL).count() >= len(kept[3])


def odd(spark, path, some):
    """A table with nulls, empty and long texts, repeated rows and ids, and clashing columns; hot numbers its rows, which lie in one file in their order."""
    at = SCHEMA.names.index("hot")
    told = [(*r[:at], str(k), *r[at + 1 :]) for k, r in enumerate(tuple(x) for x in table(spark, some).collect())]
    spark.createDataFrame(told, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def kept(out, columns):
    """The numbers of the rows that a stage keeps, once each; its columns are those of its input."""
    assert out.columns == columns
    found = [int(x["hot"]) for x in out.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_every_stage_on_odd_rows(spark, tmp_path):
    some = [*rows(), (40, None), (31, ""), (None, "y z"), (None, "y z"), (32, "  "), (7, "Call +1 (443) 555-5793 or a@b.example")]
    docs = odd(spark, f"{tmp_path}/docs", some)
    quality_of, exact_of, near_of, pii_of, pack_of = (f for _, f in corpus_pipeline.STAGES)
    scored = quality.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet"), carry=("hot",)).collect()
    assert len(scored) == len(some)
    assert kept(quality_of(spark, docs, SMALL), docs.columns) == {int(x["hot"]) for x in scored if x["score"] >= quality.THRESHOLD}

    last = {}
    for k, (d, t) in enumerate(some):
        last[t or ""] = max(((d is not None, d or 0, k), last.get(t or "", (False, 0, -1))))
    assert kept(exact_of(spark, docs, SMALL), docs.columns) == {k for _, _, k in last.values()}

    named = [(k, t) for k, (_, t) in enumerate(some)]  # by their numbers, to tell rows apart
    groups = defaultdict(list)
    for k, head, _ in brute(named):
        groups[head].append(k)
    assert kept(near_of(spark, docs, SMALL), docs.columns) == {min(g, key=lambda k: (some[k][0] is not None, some[k][0] or 0, k)) for g in groups.values()}

    masked = {int(x["hot"]): x["text"] for x in pii_of(spark, docs, SMALL).collect()}
    field = pii.fitted()
    assert masked == {k: None if t is None else pii.masked(t, pii.all_spans(t, field)[1]) for k, (_, t) in enumerate(some)}
    assert pii_of(spark, docs, SMALL).columns == docs.columns

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for d, t in some:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        wanted.update((d, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    pieces = pack_of(spark, docs, SMALL).collect()
    assert Counter((x["doc_id"], x["piece"], x["length"]) for x in pieces) == wanted
    sequences = defaultdict(list)
    for x in pieces:
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in sequences.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_every_stage_on_an_empty_table(spark, tmp_path):
    docs = odd(spark, f"{tmp_path}/docs", [])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        assert out.collect() == [] and (out.columns == docs.columns or k == 4)
