"""Small tables with the cases that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

CLASHES = ("text_sha256", "digest", "key", "n", "set", "shard", "size", "length", "bucket", "label", "score", "spans", "stretch", "edits", "keep", "part", "group", "x", "label_", "_place", "_metadata", "file", "row", "anchor", "word", "hot", "cluster", "_at", "stretch_", "who", "full")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASHES]])


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(2, 7))) + r.choice(("", "", "", ".", ",", ".\n")) for _ in range(n))


def rows(seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    base = words(r, 120)
    passage = words(r, 70)
    out: list[tuple] = [(k, words(r, r.randint(1, 150))) for k in range(25)]
    out += [(30, None), (31, ""), (32, ""), (33, "   \n "), (34, "one two"), (35, "one two"), (36, "x" * 5000), (37, words(r, 9000))]
    out += [(40 + k, base) for k in range(6)] + [(50 + k, base.replace(" ", f" w{k} ", 1)) for k in range(5)]
    out += [(60 + k, f"{words(r, 20)} {passage} {words(r, 20)}") for k in range(5)]
    out += [(70, base), (70, base), (71, base), (71, "another text"), (None, base), (None, None)]
    out += [(80, "Mail a.b@c.example.com or +1 (443) 555-5793, 4539 1488 0343 6467; 10.1.2.3 \U0001f600 (443) 555-5793"), (81, "日本語 テスト 𝔘𝔫𝔦 ﬁ Ⅷ ²   İ Σς <|endoftext|> é")]
    return out


def table(spark, some: list[tuple]):
    return spark.createDataFrame([(i, t, "xx", *["?"] * len(CLASHES)) for i, t in some], SCHEMA)
