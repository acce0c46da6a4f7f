import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import exact
from tests.llm.tables import rows, table


def brute(docs):
    groups = {}
    for doc_id, text in docs:
        groups.setdefault(text or "", []).append(doc_id)
    return {t: (max((d for d in ids if d is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.pmod(F.crc32(F.encode(t, "UTF-8")), F.lit(3)).cast("string")], ids=["sha256", "weak"])
def test_dedup(spark, digest, monkeypatch):
    monkeypatch.setattr(exact, "HOT_ROWS", 4)  # the hot way too
    docs = rows()
    found = exact.dedup(table(spark, docs), digest).collect()
    groups = brute(docs)
    assert Counter((x["doc_id"], x["keep_id"], x["group_size"]) for x in found) == Counter((d, *groups[t or ""]) for d, t in docs)
    assert sum(x["kept"] for x in found) == len(groups)
    if digest is exact.sha256:
        assert Counter(x["digest"] for x in found if x["kept"]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)


def test_kept_rows_keep_their_columns(spark):
    docs = rows()
    kept = exact.kept_rows(table(spark, docs))
    assert kept.columns == table(spark, []).columns
    assert sorted(x["text"] or "" for x in kept.collect()) == sorted(brute(docs))


def test_empty_table(spark):
    assert exact.dedup(table(spark, [])).collect() == []


WEAK = lambda t: F.pmod(F.crc32(F.encode(t, "UTF-8")), F.lit(3)).cast("string")


@pytest.mark.parametrize("digest", [exact.sha256, WEAK], ids=["sha256", "weak"])
def test_lasting_state(spark, tmp_path, digest):
    """A second call's rows meet the first call's: by the state, with texts read by locator; a call made again changes nothing."""
    first = [(1, "a"), (9, "b"), (9, "b"), (4, "c"), (5, None), (None, "only")]
    second = [(2, "a"), (3, "b"), (8, "new"), (7, "new"), (6, ""), (None, None)]
    state = f"file://{tmp_path}/state"
    for name, some, all_rows in (("one", first, first), ("two", second, first + second), ("two", second, first + second)):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(some, "doc_id long, text string").write.mode("ignore").parquet(path)
        found = exact.dedup(spark.read.parquet(path), digest, state, name).collect()
        groups = brute(all_rows)
        assert Counter((x["doc_id"], x["keep_id"], x["group_size"]) for x in found) == Counter((d, *groups[t or ""]) for d, t in some)
    assert {x["doc_id"]: x["kept"] for x in found} == {2: True, 3: False, 8: True, 7: False, 6: True, None: False}


def test_rows_of_joined_tables(spark, tmp_path):
    """Exploded rows, a table united with itself, and columns named like the operator's own."""
    spark.createDataFrame([(1, "a", "x", "y"), (2, "a", "x", "y"), (3, "b", "x", "y")], "doc_id long, text string, _place string, _metadata string").write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    struct = docs.withColumn("_place", F.struct(F.lit("f").alias("file"), F.lit(0).cast("long").alias("row")))
    for some, n in ((docs, 1), (struct, 1), (docs.unionByName(docs), 2), (docs.withColumn("e", F.explode(F.array(F.lit(1), F.lit(2)))), 2), (spark.read.parquet(f"{tmp_path}/t", f"{tmp_path}/t"), 2)):
        found = exact.dedup(some).collect()
        assert Counter((x["doc_id"], x["keep_id"], x["group_size"]) for x in found) == Counter({(1, 2, 2 * n): n, (2, 2, 2 * n): n, (3, 3, n): n})
        kept = exact.kept_rows(some)
        assert kept.columns == some.columns and sorted(x["doc_id"] for x in kept.collect()) == [2, 3]
