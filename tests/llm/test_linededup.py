import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.llm import linededup
from tests.llm.tables import rows, table

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({c: c.lower() for c in linededup.UPPER})


def plain(docs, long, many):
    """[(n_lines, n_dropped, kept text)] in the order of the documents, of which a later row counts as the larger of one doc_id."""
    holders = defaultdict(set)
    split = [(t or "").split("\n") for _, t in docs]
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for k, some in enumerate(split):
        for line in some:
            if len(key(line)) >= long:
                holders[key(line)].add(k)
    largest = {x: max(s, key=lambda k: (docs[k][0] is not None, docs[k][0] or 0, k)) for x, s in holders.items() if len(s) >= many}
    out = []
    for k, some in enumerate(split):
        stay = [line for line in some if largest.get(key(line), k) == k]
        out.append((len(some), len(some) - len(stay), "\n".join(stay)))
    return out


def found(spark, tmp_path, docs, **settings):
    table(spark, docs).coalesce(1).write.parquet(f"{tmp_path}/docs")
    out = linededup.dedup_lines(spark.read.parquet(f"{tmp_path}/docs"), carry=("text", "n"), **settings)
    kept = linededup.kept_text(F.col("text"), F.col("keep"))
    got = sorted(out.withColumn("kept", kept).collect(), key=lambda x: x["_place"]["row"])
    for x in got:
        assert sum(x["keep"]) == x["n_lines"] and sum(x["keep"][1::2]) == x["n_dropped"] and len(x["keep"]) % 2
        assert all(x["keep"][1:-1])
    return [(x["n_lines"], x["n_dropped"], x["kept"]) for x in got]


def odd():
    r = random.Random(3)
    shared = ["".join(r.choice("abcdéABC xyz") for _ in range(n)) + "z" for n in (38, 39, 40, 60, 200)]
    docs = list(rows())
    for k in range(40):
        some = ["own line of no length", *(r.choice(["", "\t ", " \x0b"]) + (x.upper() if r.random() < 0.3 and x.isascii() else x) + r.choice(["", " \r", "\t"]) for x in r.sample(shared, r.randint(0, 5)) * r.choice([1, 1, 2]))]
        docs.append((200 + k // 2, "\n".join(some)))
    docs += [(None, shared[3]), (None, shared[4] + "\n"), (500, "\n".join([shared[3]] * 400)), (501, "É" * 40), *((510 + k, ("é" if k % 2 else "É") * 45) for k in range(9))]
    return docs


def test_against_plain(spark, tmp_path):
    docs = odd()
    assert found(spark, tmp_path, docs) == plain(docs, 40, 5)


def test_hot_lines_are_decided_apart(spark, tmp_path, monkeypatch):
    """With every line a hot one, and with none, results are the same."""
    docs = odd()
    monkeypatch.setattr(linededup, "HOT_SHARE", 1000)
    assert found(spark, tmp_path, docs, long=1, many=2) == plain(docs, 1, 2)


def test_one_line_in_a_third_of_all_rows(spark, tmp_path):
    """No task of the window holds the hot line, and all its documents but one lose it."""
    docs = [(k, "hot line " * 6 + f"\nown text number {k} " * 3 if k % 3 == 0 else f"a line of document {k} that is long enough to count") for k in range(3000)]
    assert found(spark, tmp_path, docs, parts=4) == plain(docs, 40, 5)
    feed = spark.read.parquet(f"{tmp_path}/docs")
    located, place = linededup.located(feed)
    assert linededup.hot_hashes(linededup.hashed_lines(located, place, 40)).count() <= linededup.HOT_SHARE


def test_empty_table(spark):
    assert linededup.dedup_lines(table(spark, [])).collect() == []


def test_no_shuffle_between_range_and_window(spark, tmp_path):
    table(spark, odd()).write.parquet(f"{tmp_path}/docs")
    docs, place = linededup.located(spark.read.parquet(f"{tmp_path}/docs"))
    plan = linededup.dropped_lines(linededup.hashed_lines(docs, place, 40), 5, 4)._jdf.queryExecution().executedPlan().toString()
    head = plan[: plan.index("rangepartitioning")]
    assert "Window" in head and "Exchange hashpartitioning" not in head[head.index("Window") :] and "Python" not in plan and "Arrow" not in plan
