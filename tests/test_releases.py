"""Releases written by tasks: the same bytes whatever the partitions, nothing of lost tasks, and what differs later."""

import hashlib
import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.sources import releases


def rows(seed=1, n=300):
    r = random.Random(seed)
    out = [(r.choice(["train", "train", "train", "test", "é x"]), r.randint(0, 50), "".join(r.choice('ab"\\\né') for _ in range(r.randint(0, 9)))) for _ in range(n)]
    return out + [("train", 7, "twice"), ("train", 7, "twice"), ("one", None, None)]


SCHEMA = "part string, k long, text string"


def wanted(some, lines):
    """path -> content."""
    by = {}
    for part, k, text in some:
        fields = {"k": k, "text": text}
        by.setdefault(part, []).append((k is not None, k or 0, json.dumps({c: v for c, v in fields.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))))
    out = {}
    for part, told in by.items():
        told.sort(key=lambda x: (x[0], x[1], x[2].encode()))
        for low in range(0, len(told), lines):
            name = f"{part}.jsonl" if len(told) <= lines else f"{part}-{low // lines:06d}.jsonl"
            out[name] = "".join(f"{x[2]}\n" for x in told[low : low + lines]).encode()
    return out


@pytest.mark.parametrize("lines", [7, 1000])
def test_files_are_the_same_for_any_partitions(spark, tmp_path, lines):
    some = rows()
    for parts in (1, 5):
        folder = f"{tmp_path}/{parts}"
        releases.write_files(spark.createDataFrame(random.Random(parts).sample(some, len(some)), SCHEMA).repartition(parts), "part", "k", folder, lines, {"name": "small"})
        made = json.load(open(f"{folder}/manifest.json"))
        contents = wanted(some, lines)
        assert made["name"] == "small" and {e["path"] for e in made["files"]} == set(contents)
        for e in made["files"]:
            data = open(f"{folder}/{e['path']}", "rb").read()
            assert data == contents[e["path"]]
            assert (e["sha256"], e["bytes"], e["records"]) == (hashlib.sha256(data).hexdigest(), len(data), data.count(b"\n"))
        assert sorted(x for x in os.listdir(folder) if not x.endswith(".crc")) == sorted([*contents, "manifest.json"])
        assert releases.release_problems(spark, folder).collect() == []
    with pytest.raises(PySparkException, match="made once"):
        releases.write_files(spark.createDataFrame(some, SCHEMA), "part", "k", folder, lines, {})


def test_a_lost_task_leaves_nothing_in_a_manifest(spark, tmp_path):
    """A task breaks off in the middle of its file, after others have written theirs: no manifest, no half file; the next try makes the release."""
    folder = f"{tmp_path}/out"
    some = spark.createDataFrame(rows(), SCHEMA)
    spark.dataSource.register(releases.ReleaseFiles)
    lines = some.select(F.concat("part", F.lit(".jsonl")).alias("path"), F.col("text").alias("line")).repartition("path").sortWithinPartitions("path")
    broken = lines.withColumn("line", F.when(F.col("line") == "twice", F.raise_error(F.lit("an executor is lost"))).otherwise(F.col("line")))
    with pytest.raises(PySparkException, match="an executor is lost"):
        broken.write.format(releases.FORMAT).mode("append").option("manifest", "manifest.json").option("about", "{}").save(folder)
    left = os.listdir(folder) if os.path.isdir(folder) else []
    assert "manifest.json" not in left and not any(x.startswith(".train") for x in left)
    releases.write_files(some, "part", "k", folder, 50, {})
    assert releases.release_problems(spark, folder).filter("problem <> 'unexpected'").collect() == []


def test_an_attempt_again_replaces_its_file(tmp_path):
    import pyarrow as pa

    writer = releases.FileWriter({"path": str(tmp_path), "manifest": "m.json", "about": "{}"})
    batch = pa.RecordBatch.from_pylist([{"path": "a/x.jsonl", "line": "1"}, {"path": "a/x.jsonl", "line": "2"}, {"path": "b.jsonl", "line": "3"}])
    first, again = (writer.write(iter([batch.slice(0, 1), batch.slice(1)])) for _ in range(2))
    assert first == again and [e["records"] for e in first.entries] == [2, 1]
    writer.commit([first, None])
    assert [e["path"] for e in releases.get_json(str(tmp_path), "m.json")["files"]] == ["a/x.jsonl", "b.jsonl"]
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([first, again])

    def lost():
        yield batch.slice(0, 1)
        raise OSError("gone")

    with pytest.raises(OSError, match="gone"):
        writer.write(lost())
    assert sorted(os.listdir(tmp_path / "a")) == ["x.jsonl"]
    for odd in ("../x", "/x", ""):
        with pytest.raises(ValueError, match="root"):
            writer.write(iter([pa.RecordBatch.from_pylist([{"path": odd, "line": "1"}])]))
    writer.abort([first])
    assert not os.path.exists(tmp_path / "a/x.jsonl")


def test_freeze_and_problems(spark, tmp_path):
    folder, other = f"{tmp_path}/out", f"{tmp_path}/tokenizer.json"
    open(other, "w").write("{}")
    releases.write_files(spark.createDataFrame(rows(), SCHEMA), "part", "k", folder, 40, {})
    made = releases.freeze(spark, folder, "freeze.json", {"outcome": "approved"}, {"tokenizer": other})
    assert made["records"] == 303 and made["linked"]["tokenizer"]["sha256"] == hashlib.sha256(b"{}").hexdigest()
    assert releases.release_problems(spark, folder, "freeze.json").collect() == []
    with pytest.raises(FileExistsError, match="frozen once"):
        releases.freeze(spark, folder, "freeze.json", {})
    open(f"{folder}/test.jsonl", "ab").write(b"x\n") if os.path.exists(f"{folder}/test.jsonl") else open(f"{folder}/test-000000.jsonl", "ab").write(b"x\n")
    os.remove(f"{folder}/one.jsonl")
    open(f"{folder}/new.jsonl", "w").write("{}\n")
    open(other, "w").write("[]")
    changed = json.load(open(f"{folder}/freeze.json")) | {"status": "open"}
    json.dump(changed, open(f"{folder}/freeze.json", "w"))
    found = {(x["path"], x["problem"]) for x in releases.release_problems(spark, folder, "freeze.json").collect()}
    assert found == {("test-000000.jsonl" if os.path.exists(f"{folder}/test-000000.jsonl") else "test.jsonl", "changed"), ("one.jsonl", "missing"), ("new.jsonl", "unexpected"), (other, "changed"), ("freeze.json", "changed")}


def test_ranks_of_a_hot_part(spark):
    """One part with most rows lies in several ranges, and its numbers run on through them."""
    df = spark.range(4000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 70).cast("string"))).alias("p"), (F.hash("id") % 500).alias("k"), "id")
    found = releases.ranked(df, "p", ["k", "id"], "r", "t").collect()
    by = {}
    for x in found:
        by.setdefault(x["p"], []).append(x)
    for some in by.values():
        assert [x["r"] for x in sorted(some, key=lambda x: (x["k"], x["id"]))] == list(range(1, len(some) + 1)) and {x["t"] for x in some} == {len(some)}
    assert releases.ranked(df.limit(0), "p", ["k", "id"], "r", "t").collect() == []
