"""Releases, reports, settings, and what pairs, limits and batches rows."""

import hashlib
import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.functions.exprs import ascii_digits, ordered_rank, utc_stamp
from millrace.operators import extract, qc, score, split, stats, tokens, training
from millrace.plans import registry
from millrace.sources import cases, config, sinks, tables

SMALL = "/root/testdata/sf0.001"


def test_partition_columns_are_partition_counts(spark):
    r = random.Random(5)
    for ratios in ((0.8, 0.1, 0.1), (1.0, 0.0, 0.0), (0.25, 0.25, 0.5), (1 / 3, 1 / 3, 1 / 3)):
        totals = [0, 1, 2, 3, 7, 10, 11, *[r.randint(0, 10**6) for _ in range(30)]]
        rows = spark.createDataFrame([(n,) for n in totals], "n long").select("n", *[c.alias(f"c{k}") for k, c in enumerate(split.partition_columns(F.col("n"), ratios))]).collect()
        assert all([x["c0"], x["c1"], x["c2"]] == split.partition_counts(x["n"], ratios) for x in rows)


def test_assign_of_unique_rows_is_the_same(spark):
    rows = spark.createDataFrame([(f"case {k}", k) for k in range(300)], "c string, k long")
    both = [{x["c"]: x["split"] for x in split.assign(rows, "c", unique=u).collect()} for u in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 300
    assert split.assign(rows.filter("k < 0"), "c", unique=True).collect() == []


def test_ordered_rank(spark):
    keys = random.Random(2).sample(range(-(10**9), 10**9), 700)
    found = ordered_rank(spark.createDataFrame([(k,) for k in keys], "k long"), "k", "n", buckets=16).collect()
    assert {x["k"]: x["n"] for x in found} == {k: n for n, k in enumerate(sorted(keys), 1)}
    assert ordered_rank(spark.createDataFrame([], "k long"), "k").collect() == []


def test_sequential_batches(spark):
    found = training.sequential_batches(spark.createDataFrame([(k * 3,) for k in range(11)], "k long"), "k", 4).orderBy("k").collect()
    assert [(x["batch"], x["slot"]) for x in found] == [(n // 4, n % 4) for n in range(11)]


def test_aligned(spark):
    gold = spark.createDataFrame([(k, f"g{k}") for k in range(5)], "id long, gold string")
    predicted = spark.createDataFrame([(k, f"p{k}") for k in (3, 1, 4, 0, 2)], "id long, text string")
    assert {(x["id"], x["gold"], x["text"]) for x in score.aligned(predicted, gold, ["id"]).collect()} == {(k, f"g{k}", f"p{k}") for k in range(5)}
    for odd in (predicted.filter("id <> 3"), predicted.union(predicted.filter("id = 2")), predicted.union(spark.createDataFrame([(9, "x")], "id long, text string"))):
        with pytest.raises(PySparkException, match="differ at"):
            score.aligned(odd, gold, ["id"]).collect()


def test_first_unique_cases(spark):
    drawn = cases.identified(cases.draw_exams(cases.attempts(spark, 400)))
    every = sorted(x["attempt"] for x in cases.unique_cases(drawn).collect())
    assert sorted(x["attempt"] for x in cases.unique_cases(drawn, 30).collect()) == every[:30]


def test_constant_rows(spark):
    assert cases.constant_rows(spark, [{"b": 1, "a": "x"}], "a string, b long").first() == ("x", 1)
    with pytest.raises(ValueError, match="keys differ"):
        cases.constant_rows(spark, [{"a": "x"}], "a string, b long")


def test_every_defect(spark):
    rows = spark.createDataFrame([(d,) for d in vocab.DEFECTS], "defect_id string")
    assert qc.every_defect(rows).count() == len(vocab.DEFECTS)
    with pytest.raises(ValueError, match="unit_mixed"):
        qc.every_defect(rows.filter("defect_id <> 'unit_mixed'"))


def test_digits_and_blanks_of_other_scripts(spark):
    texts = [("大小约１２×８mm", [12.0, 8.0]), ("大小约 1.2 × ٣.٥ cm", [12.0, 35.0]), ("大小约9　×　6　mm", [9.0, 6.0]), ("大小约9 x 6", [9.0, 6.0]), ("九×六mm", None)]
    found = spark.createDataFrame([(t,) for t, _ in texts], "t string").select("t", extract.dimensions(F.col("t")).alias("d")).collect()
    assert {x["t"]: x["d"] for x in found} == dict(texts)
    assert spark.range(1).select(ascii_digits(F.lit("a０９९१b7"))).first()[0] == "a0991b7"


def test_bundle(spark, tmp_path):
    rows = spark.createDataFrame([("train", 3, "c"), ("train", 1, "a\né"), ("test", 2, 'b"')], "part string, k long, text string")
    statistics = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    made = sinks.write_bundle(rows, "part", "k", statistics, f"{tmp_path}/out", "small", {"seeds": [1]})
    assert json.load(open(f"{tmp_path}/out/manifest.json")) == made and made["seeds"] == [1]
    for name, entry in made["files"].items():
        content = open(f"{tmp_path}/out/{entry['path']}", "rb").read()
        assert (entry["sha256"], entry["bytes"]) == (hashlib.sha256(content).hexdigest(), len(content))
        if name != "statistics":
            assert entry["records"] == content.count(b"\n")
    assert [json.loads(line) for line in open(f"{tmp_path}/out/train.jsonl")] == [{"k": 1, "text": "a\né"}, {"k": 3, "text": "c"}]
    assert json.load(open(f"{tmp_path}/out/statistics.json")) == [{"part": "test", "n": 1}, {"part": "train", "n": 2}]
    with pytest.raises(FileExistsError):
        sinks.write_bundle(rows, "part", "k", statistics, f"{tmp_path}/out", "small")


def test_frozen_challenge(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "challenge_id string, n long")
    path, record = f"{tmp_path}/set.jsonl", f"{tmp_path}/freeze.json"
    open(f"{tmp_path}/train.json", "w").write("{}")
    made = sinks.write_frozen(rows, "challenge_id", path, record, {"method": "made up"}, {"training": f"{tmp_path}/train.json"})
    assert [json.loads(x)["n"] for x in open(path)] == [1, 2] and made["file"]["records"] == 2 and made["linked"]["training"]["sha256"] == hashlib.sha256(b"{}").hexdigest()
    assert sinks.frozen_problems(path, record) == []
    with pytest.raises(FileExistsError):
        sinks.write_frozen(rows, "challenge_id", path, record, {})
    open(path, "a").write("x\n")
    assert sinks.frozen_problems(path, record) == ["file"]
    changed = json.load(open(record)) | {"status": "open"}
    json.dump(changed, open(record, "w"))
    assert sinks.frozen_problems(path, record) == ["record", "file"]


def test_three_reports(spark):
    rates = registry.queries()["split_rates"](spark, SMALL)
    losses = spark.createDataFrame([("location_first_v2", 0.25, None)], "template_family string, loss double, accuracy double")
    text = sinks.generate_report(rates, "template_family", {"Device": "cpu", "Step": None}, losses)
    assert text.startswith("# Generated reports") and "- Loss: `0.2500`" in text and "- Token accuracy: `–`" in text and text.count("\n## ") == 4
    exact = registry.queries()["extract_exact_structure"](spark, SMALL)
    assert sinks.extract_report(rates, exact, "template_family", {}).count("Whole record exact") == 4
    checked = sinks.qc_report(registry.queries()["qc_clean_rollup"](spark, SMALL), "template_family", registry.queries()["defect_recall"](spark, SMALL), {})
    assert "Micro recall" in checked and all(f"## {d}" in checked for d in vocab.DEFECTS)


def test_model_settings(tmp_path):
    sizes = dict(vocab_size=300, max_seq_len=64, n_layers=2, n_heads=4, d_model=32, d_ff=64)
    made = config.ModelConfig(**sizes)
    config.save(made, f"{tmp_path}/m.json")
    assert config.load_model(f"{tmp_path}/m.json") == made and made.head_dim == 8
    for odd in ({"n_heads": 5}, {"dropout": 1.0}, {"d_ff": 0}, {"n_layers": True}):
        with pytest.raises(ValueError):
            config.ModelConfig(**(sizes | odd))
    json.dump({"config_version": "0", **sizes}, open(f"{tmp_path}/m.json", "w"))
    with pytest.raises(ValueError, match="config_version"):
        config.load_model(f"{tmp_path}/m.json")


def test_device_poll(spark):
    row = tables.poll_devices(spark, ["echo", "61, 98, 2048, [N/A]"]).first()
    assert (row["temperature_c"], row["memory_used_mib"], row["power_w"]) == (61.0, 2048.0, None) and row["at"].endswith("+00:00")
    assert tables.poll_devices(spark, ["false"]).collect() == [] and tables.poll_devices(spark, ["/no/such/command"]).collect() == []


def test_time_stamps(spark):
    import datetime

    long, short = spark.range(1).select(utc_stamp(), utc_stamp(False)).first()
    now = datetime.datetime.now(datetime.UTC)
    assert abs((datetime.datetime.fromisoformat(long) - now).total_seconds()) < 300 and len(short) == 8 and short.isdigit()


def test_tokenizers(spark):
    import public_tokenizers

    piece = tokens.SentencePieceTokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    character = tokens.CharacterTokenizer(list("abc d"))
    assert isinstance(piece, tokens.Tokenizer) and isinstance(character, tokens.Tokenizer)
    rows = spark.createDataFrame([("a bad cab",), ("",), (None,)], "t string")
    for t in (piece, character):
        found = [x["d"] for x in rows.select(t.decode(t.encode(F.col("t"))).alias("d")).collect()]
        assert found[:2] == ["a bad cab", ""]
    assert character.special("<eos>") == 2 and piece.special("<s>") >= 0
    for t in (piece, character):
        with pytest.raises(KeyError):
            t.special("bad")


def test_counts_and_unions(spark):
    ids = spark.createDataFrame([([3, 5, 3],), ([],)], "ids array<int>")
    assert [x[0] for x in ids.select(tokens.count_of("ids", "<unk>")).collect()] == [2, 0]
    pair = spark.createDataFrame([(1, "x", "y")], "id long, input string, target string")
    assert sorted(map(tuple, tables.text_rows(pair, ["input", "target"]).collect())) == [(1, "input", "x"), (1, "target", "y")]
    more = spark.createDataFrame([(k, k % 2) for k in range(9)], "k long, odd long")
    assert [x["k"] for x in tables.with_first_of(more.filter("k = 8"), more, F.col("odd") == 1, "k", 2).collect()] == [8, 1, 3]


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        sinks.shared_folder(Cluster)
    assert os.path.isdir(sinks.shared_folder(spark).removeprefix("file://").rpartition("/")[0])


def test_statistics_of_no_rows(spark):
    empty = spark.createDataFrame([], ", ".join([*(f"{f} string" for f in vocab.FIELDS), "dims array<double>", "dims_state string", "part string", "sample_id string", "semantic_case_id string", "input string", "target string", "template_family string"]))
    assert stats.assembled(empty, "part").collect() == []


def test_statistics_of_odd_rows(spark, monkeypatch):
    """Nulls, repeated rows and cases in several groups are counted as plain Python does; no text is written or shuffled on the way."""
    r = random.Random(3)
    base = {f: codes[0] for f, codes in vocab.DOMAINS.items()}
    rows = []
    for k in range(160):
        case = r.randrange(60)
        record = base | {"margin": (None, "smooth", "unknown", "odd")[case % 4], "dims": None if case % 5 == 0 else [1.0 + case, 2.0, 3.0][: 2 + case % 2], "dims_state": "unknown" if case % 5 == 0 else None}
        own = {"part": r.choice(["train", "test", "all", None]), "sample_id": f"s{r.randrange(120)}", "semantic_case_id": None if case == 7 else f"c{case}", "input": f"i{case}", "target": None if k % 9 == 0 else "t" * r.randrange(30), "template_family": r.choice(["f", "g"])}
        rows.append(record | own)
    names = [*vocab.FIELDS, "dims", "dims_state", "part", "sample_id", "semantic_case_id", "input", "target", "template_family"]
    kinds = ", ".join(f"{c} {'array<double>' if c == 'dims' else 'string'}" for c in names)
    written, whole = [], sinks.materialized
    monkeypatch.setattr(stats, "materialized", lambda df: written.append(df) or whole(df))
    found = {(x["part"], x["statistic"], x["name"]): x["value"] for x in stats.assembled(spark.createDataFrame([tuple(x[c] for c in names) for x in rows], kinds), "part").collect()}
    assert written and not any({("input", "string"), ("target", "string")} & set(df.dtypes) for df in written)
    wanted = {}
    both = [*rows, *[x | {"part": "all"} for x in rows]]
    for part in {x["part"] for x in both}:
        own = [x for x in both if x["part"] == part]
        once = {x["semantic_case_id"]: x for x in own}
        known = lambda c: {x[c] for x in own if x[c] is not None}  # noqa: E731, B023
        wanted |= {(part, "rows", "samples"): len(own), (part, "rows", "semantic_cases"): len(known("semantic_case_id"))}
        wanted |= {(part, "duplicate_rows", c): len(own) - len(known(c)) for c in ("sample_id", "semantic_case_id", "input", "target")}
        for c in ("input", "target"):
            n = sorted(len(x[c]) for x in own if x[c] is not None)
            wanted |= {(part, f"{c}_chars", "min_length"): n[0], (part, f"{c}_chars", "max_length"): n[-1], (part, f"{c}_chars", "mean_length"): round(sum(n) / len(n), 3)}
            wanted |= {(part, f"{c}_chars", f"p{p}"): n[-(-len(n) * p // 100) - 1] for p in (50, 90, 95, 99)}
        single = [(f"field {n}", x[c]) for n, c in stats.SPECIFIED.items() for x in once.values()] + [("template_family", x["template_family"]) for x in own]
        single += [("missing_state", v) for x in once.values() for v in [*(x[c] for c in stats.SPECIFIED.values()), x["dims_state"]] if v in vocab.MISSING]
        single += [("dimension_count", str(len(x["dims"]))) for x in once.values() if x["dims"]]
        for statistic, name in single:
            wanted[part, statistic, name] = wanted.get((part, statistic, name), 0) + 1
        sizes = [v for x in once.values() for v in x["dims"] or ()]
        wanted |= {(part, "dimension_mm", "least"): min(sizes), (part, "dimension_mm", "largest"): max(sizes)}
    assert found == wanted


def test_unique_cases_are_cut_where_they_lie(spark):
    rows = spark.createDataFrame([(f"case {k}", "x") for k in range(500)], "c string, other string")
    for ratios in ((0.8, 0.1, 0.1), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.25, 0.25, 0.5)):
        both = [{x["c"]: x["split"] for x in split.assign(rows, "c", ratios, unique=u).collect()} for u in (False, True)]
        assert both[0] == both[1]
    plan = split.assign(rows, "c", unique=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "other" not in "".join(line for line in plan.splitlines() if "Window" in line or "Aggregate" in line) and "Join Cross" in plan
