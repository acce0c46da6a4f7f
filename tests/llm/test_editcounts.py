import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F

from millrace.llm import bytebpe, editcounts, queries
from tests.llm.tables import rows, table, words

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_tree_against_whole_encoding():
    count = editcounts.counter(RANKS, PATTERN)
    r = random.Random(3)
    for round_ in range(60):
        text = words(r, r.randint(0, 60))
        tree = editcounts.CountTree(bytebpe.parts(text, r.choice((1, 8, 40))), count)
        for _ in range(12):
            position, removed = r.randint(-2, len(text) + 3), r.randint(0, 30)
            inserted = r.choice(("", " ", "\n", "abc", "  x", "'s", " and more words\n", "12", "…"))
            at = max(0, min(position, len(text)))
            text = text[:at] + inserted + text[at + max(0, removed) :]
            tree.edit(position, removed, inserted)
            assert "".join(tree.leaves) == text
            assert tree.tokens[1] == len(bytebpe.encoding(RANKS, PATTERN).encode_ordinary(text)), (round_, text)
            assert all(tree.tokens[k] == tree.tokens[2 * k] + tree.tokens[2 * k + 1] for k in range(1, tree.width))


def test_only_touched_leaves_are_encoded():
    seen = []
    count = editcounts.counter(RANKS, PATTERN)
    tree = editcounts.CountTree(bytebpe.parts(words(random.Random(1), 3000), 200), lambda t: seen.append(len(t)) or count(t))
    seen.clear()
    tree.edit(9000, 5, "word")
    assert 0 < sum(seen) < 1500


def test_registered_edits(spark):
    """The query's own script: every row against whole encodings of both texts, and less than 15 % of the edited characters encoded again."""
    small = "/root/testdata/sf0.001"
    whole = bytebpe.encoding(RANKS, PATTERN)
    expected = {}
    for x in spark.read.parquet(f"{small}/documents.parquet").collect():
        t = x["text"] or ""
        n, new = len(t), t
        for at, removed, inserted in ((n // 6, 16, t[-12:]), (n // 2, 9, ""), (n * 5 // 6, 0, "\n" + t[:24]), (n + 24, 0, " edited")):
            at = min(at, len(new))
            new = new[:at] + inserted + new[at + removed :]
        expected[x["doc_id"]] = (n, len(whole.encode_ordinary(t)), len(new), len(whole.encode_ordinary(new)), hashlib.sha256(new.encode()).hexdigest())
    found = queries.op7_edit_aware_counts(spark, small).collect()
    assert {x["doc_id"]: (x["n_chars"], x["n_tokens"], x["edited_chars"], x["edited_tokens"], x["edited_sha256"]) for x in found} == expected
    assert sum(x["encoded_chars"] for x in found) < 0.15 * sum(x["edited_chars"] for x in found)


def test_query_form(spark):
    docs = rows()
    trees = editcounts.count_trees(table(spark, docs), RANKS, PATTERN)
    script = F.array(F.struct(F.lit(3).cast("long").alias("position"), F.lit(4).cast("long").alias("removed"), F.lit(" new\n").alias("inserted")))
    whole = bytebpe.encoding(RANKS, PATTERN)
    found = editcounts.apply_edits(trees.withColumn("edits", script), RANKS, PATTERN).collect()
    expected = []
    for d, t in docs:
        t = t or ""
        new = t[:3] + " new\n" + t[7:]
        expected.append((d, len(t), len(whole.encode_ordinary(t)), new, len(whole.encode_ordinary(new))))
    key = lambda x: (str(x[0]), x[3])
    assert sorted(((x["doc_id"], x["n_chars"], x["n_tokens"], x["edited"], x["edited_tokens"]) for x in found), key=key) == sorted(expected, key=key)
    assert editcounts.count_trees(table(spark, []), RANKS, PATTERN).collect() == []
