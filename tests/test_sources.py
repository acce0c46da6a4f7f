import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.operators import challenge, render
from millrace.sources import cases, sinks, tables


@pytest.fixture
def samples(spark):
    return render.render_cases(cases.unique_cases(cases.identified(cases.draw_exams(cases.attempts(spark, 40)))))


def test_json_lines_round_trip(spark, samples, tmp_path):
    sinks.write_json_lines(samples, f"{tmp_path}/a", "sample_id")
    sinks.write_json_lines(samples.repartition(3), f"{tmp_path}/b", "sample_id")
    read = lambda p: "".join(f.read_text() for f in sorted((tmp_path / p).glob("part-*")))
    assert read("a") == read("b")
    first = json.loads(read("a").splitlines()[0])
    assert list(first) == sorted(first)
    back = tables.generated(spark, f"{tmp_path}/a", "train", limit=5)
    assert back.count() == 5 and back.columns == ["example_id", "split", "semantic_case_id", "input", "reference_text"]
    with pytest.raises(PySparkException):
        sinks.write_json_lines(samples, f"{tmp_path}/a", "sample_id")
    with pytest.raises(ValueError):
        (tmp_path / "empty").mkdir()
        (tmp_path / "empty" / "x.json").write_text("")
        tables.generated(spark, f"{tmp_path}/empty", "train")


def test_bad_rows_are_errors(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"sample_id": 3, "seed": "no number"}\n')
    with pytest.raises(Exception, match="seed"):
        tables.generated(spark, f"{tmp_path}/x.json", "train").collect()


def test_fixtures(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"sample_id":"f1","structure":{"nodules":[{"location":{"side":"left","segment":"upper"},"dimensions_mm":[5,4.5]}]},"report":"x"}\n{"sample_id":"f2","structure":{"nodules":[{"location":{"side":"isthmus","segment":"not_applicable"},"dimensions_mm":"unknown"}],"lymph_nodes":"suspicious"},"report":"y"}\n')
    a, b = tables.fixtures(spark, f"{tmp_path}/f.json").orderBy("example_id").collect()
    assert a["dims"] == [5.0, 4.5] and a["margin"] == "not_mentioned" and a["lymph_nodes"] == "not_mentioned"
    assert b["dims"] is None and b["dims_state"] == "unknown" and b["lymph_nodes"] == "suspicious"


def test_manifest_finds_tampering(spark, samples, tmp_path):
    sinks.write_release(samples.withColumn("part", F.lit("train")), f"{tmp_path}/r", "part", "sample_id")
    recorded = spark.createDataFrame(sinks.manifest(spark, f"{tmp_path}/r", "*.parquet").collect())
    assert sinks.verify(spark, recorded, f"{tmp_path}/r", "*.parquet").isEmpty()
    victim = next((tmp_path / "r").rglob("*.parquet"))
    (victim.parent / f".{victim.name}.crc").unlink()
    victim.write_bytes(victim.read_bytes()[:-1] + b"?")
    (victim.parent / "extra.parquet").write_bytes(b"x")
    assert {r["problem"] for r in sinks.verify(spark, recorded, f"{tmp_path}/r", "*.parquet").collect()} == {"changed", "unexpected"}


def test_chain_and_paths(tmp_path):
    records = {"data": {"sha256": "1"}, "tokenizer": {"sha256": "2", "of:data": "1"}, "freeze": {"sha256": "3", "of:data": "1", "of:tokenizer": "x"}}
    assert sinks.chain_problems(records) == ["freeze -> tokenizer"]
    assert sinks.safe_relative("a/b.json") == "a/b.json"
    for bad in ("", "/etc/x", "a/../../b", "..\\x"):
        with pytest.raises(ValueError):
            sinks.safe_relative(bad)
    sinks.write_json({"b": 1, "a": "é"}, f"{tmp_path}/x.json")
    assert (tmp_path / "x.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'


def test_markdown(spark):
    text = sinks.markdown(spark.createDataFrame([("b", 0.5), ("a", None)], "k string, v double"), "Rates", ["k"])
    assert text.splitlines()[2:] == ["| k | v |", "| --- | --- |", "| a | – |", "| b | 0.5000 |"]


def test_telemetry_rows(spark):
    rows = tables.telemetry(spark.createDataFrame([("61, 97, 1500, 80.5",), ("60, 90, 1400, [N/A]",)], "value string")).collect()
    assert rows[0]["power_w"] == 80.5 and rows[1]["power_w"] is None and rows[1]["temperature_c"] == 60


def test_challenge_repeats_and_leaks(spark):
    rows = cases.identified(cases.draw_exams(cases.attempts(spark, 3))).withColumn("reference_report", F.lit("左叶可见结节")).withColumn("difficulty_tags", F.array(F.lit("a"), F.lit("a")))
    checked = challenge.validate(rows, rows.limit(1), rows.select("reference_report").limit(1))
    assert all("leaked_report" in r["problems"] for r in checked.collect()) and checked.filter(F.array_contains("problems", "leaked_case")).count() == 1
    found = {r["check"] for r in challenge.repeated(checked).collect()}
    assert found == {"reference_report", "difficulty_tags"}
