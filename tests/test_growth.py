"""What keeps queries in bounds as their tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.operators import decoder, extract, qc, score, tokens
from millrace.plans import records, registry
from millrace.sources import cases, sinks, tables

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_turns_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for name in ("decoder_parity", "decoder_attention", "decoder_scores"):
        assert f"RoundRobinPartitioning({4 * cores})" in plan(registry.queries()[name](spark, SMALL))


def test_characters_are_looked_up_by_code_point(spark):
    known = ["a", "é", "中", "😀"]
    rows = spark.createDataFrame([("a中😀",), ("éxß",), ("",), (None,)], "t string").select(tokens.encode(F.col("t"), known).alias("ids"))
    first = vocab.FIRST_CHARACTER
    assert [r["ids"] for r in rows.collect()] == [[first, first + 2, first + 3], [first + 1, *(b + vocab.FIRST_BYTE for b in "xß".encode())], [], None]
    assert "map(" not in plan(rows) and "keys:" not in plan(rows)  # no search through the vocabulary for each character


def test_places_asked_for_and_ids_counted():
    config = decoder.Config(50, width=8, heads=2, layers=2, longest=700)
    weights, ids = decoder.random_weights(config, 3), np.random.default_rng(1).integers(0, 50, (1, 600))
    at = np.array([0, 299, 300, 599])
    assert np.allclose(decoder.Decoder(config, weights).states(ids)[:, at], decoder.Decoder(config, weights).states(ids, places=at), rtol=0, atol=1e-12)
    flat = weights | {"place": np.zeros_like(weights["place"])}
    held = [None] * 2  # with keys that are held, places are worked out one by one
    assert np.allclose(decoder.Decoder(config, flat).states(ids), decoder.Decoder(config, flat).states(ids, held), rtol=0, atol=1e-12)


def test_records_are_shuffled_as_numbers(spark):
    drawn = cases.draw_exams(cases.attempts(spark, 3000)).filter("attempt % 7 > 0")
    twice = drawn.union(drawn.withColumn("attempt", F.col("attempt") + 10_000))
    columns = ["attempt", *vocab.FIELDS, "dims", "dims_state", "semantic_case_id"]
    slim = cases.identified(cases.unique_records(twice, 3))
    assert sorted(map(repr, slim.select(columns).collect())) == sorted(map(repr, cases.unique_cases(cases.identified(twice)).select(columns).collect()))
    assert "Window" not in plan(records.exams(spark, SMALL))


def test_texts_are_cut_into_clauses(spark):
    texts = ["甲状腺左叶上部见一枚实性低回声结节，边缘光滑。", "峡部见囊、实结节，大小约1.2×3cm", "左1叶", "极低，回声", "", None, "  右侧叶 12 × 8.5 × 7 mm　", "非高于宽，前后径超过横径"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    from millrace.functions.exprs import first_match

    found = extract.extract(rows, "t").select("t", "parsed_dims", *[F.col("parsed_" + f).alias(f) for f in vocab.CASCADES])
    plainly = rows.select("t", *[first_match(F.col("t"), rules, "not_mentioned").alias(f) for f, rules in vocab.CASCADES.items()])
    wanted = {r["t"]: r.asDict() for r in plainly.collect()}
    for r in found.collect():
        isthmus = vocab.ISTHMUS in (r["t"] or "")
        own = wanted[r["t"]] | ({"location_side": "isthmus", "location_segment": "not_applicable"} if isthmus else {})
        assert {f: r[f] for f in vocab.CASCADES} == {f: own[f] for f in vocab.CASCADES}
    assert {r["t"]: r["parsed_dims"] for r in found.collect() if r["parsed_dims"]} == {texts[1]: [12.0, 30.0], texts[6]: [12.0, 8.5, 7.0]}
    assert plan(found).count("Contains") < 20


def test_each_side_of_a_pair_is_read_once(spark, tmp_path):
    spark.range(50).selectExpr("id", "id * 2 AS x").write.parquet(str(tmp_path / "t"))
    held = spark.read.parquet(str(tmp_path / "t"))
    both = score.aligned(held.select("id", F.col("x").alias("p")), held.select("id", F.col("x").alias("g")), ["id"])
    assert plan(both).count("FileScan") == 2 and both.filter("p = g").count() == 50


def test_few_rows_go_on_to_be_injected(spark):
    rows = cases.identified(cases.draw_exams(cases.attempts(spark, 400)))
    from millrace.operators import render

    made = render.fragments(rows).withColumn("target", render.report("location_first_v2"))
    every = qc.inject(made, "target", "attempt")
    wanted = sorted((r["defect_id"], r["attempt"], r["target"]) for r in every.collect())
    firsts = [x for d in vocab.DEFECTS for x in [w for w in wanted if w[0] == d][:5]]
    some = qc.inject(made, "target", "attempt", 5)
    assert sorted((r["defect_id"], r["attempt"], r["target"]) for r in some.collect()) == sorted(firsts)
    assert "LeftSemi" in plan(some)


def test_written_lines_are_compressed(spark, monkeypatch):
    folders = []
    whole = sinks.shared_folder
    monkeypatch.setattr(sinks, "shared_folder", lambda *a: folders.append(whole(*a)) or folders[-1])
    for name in ("release_round_trip", "challenge_round_trip"):
        assert registry.queries()[name](spark, SMALL).count() > 0
        files = spark.read.format("binaryFile").load(folders[-1]).select("path").collect()
        assert files and all(r["path"].endswith(".gz") for r in files)


def test_deltas_of_one_pass(spark):
    assert plan(registry.queries()["metric_delta"](spark, SMALL)).count("sha2") == 0  # its records aren't drawn for each run


def test_tasks_follow_the_rows(spark):
    assert tables.task_count(spark.range(1000), 10) == 100


def test_reports_of_a_kind_are_checked_once(spark):
    """Findings of one report of each kind, times how many are alike, are those of all reports; and no finding asks for more of a number than that it is one."""
    attempts = cases.attempts(spark, 1500)
    every = cases.unique_records(cases.draw_exams(attempts), 3)
    some = records.kinds(attempts.union(attempts), 3)
    total = some.agg(F.count(F.lit(1)).alias("n"), F.sum("alike").alias("alike")).first()
    assert total["n"] < total["alike"] and total["alike"] == every.count()
    found = {tuple(r) for r in records.text_findings(some).collect()}
    assert found == {tuple(r) for r in records.text_findings(every.withColumn("alike", F.lit(1).cast("bigint"))).collect()}
    assert {r[0] for r in found} == {"diagnostic_language", "text_contradiction", "unit_mixed"}
    texts = ["结节，大小约{}×{}mm。", "大小约{}×{}mm（约{}cm）", "{}mm {}cm", "{} {}", "{}，考虑恶性可能"]
    filled = [(k, t.format(*numbers)) for k, t in enumerate(texts) for numbers in (("1", "2", "3"), ("12.5", "9", "17.0"), ("0", "4.25", "1"), ("30", "40.0", "0.5"))]
    said = qc.run_qc(spark.createDataFrame(filled, "k int, t string"), "t", with_record=False).select("k", F.transform("findings", lambda f: f["rule_id"]).alias("rules")).distinct()
    assert said.count() == len(texts)
    rules = [*vocab.DIAGNOSTIC, *vocab.ANCHORS, *vocab.NO_DIMENSIONS, *(p for own in vocab.PHRASES.values() for p in own.values())]
    assert not any(c.isdigit() for p in rules for c in p)


@pytest.mark.parametrize("size", [0.1, 2.0, 60.0])
def test_attention_in_small_blocks(monkeypatch, size):
    """Blocks of any size, and scores that are small, middling or too large for exponentials without their maximum, give what plain shares give."""
    r = np.random.default_rng(6)
    q, key, value = (r.normal(0, s, (2, 2, 40, 4)) for s in (size, size, 1.0))
    at = np.array([0, 5, 6, 7, 21, 39])
    scores = q[:, :, at] @ key.transpose(0, 1, 3, 2) / 2
    scores[..., np.arange(40) > at[:, None]] = -np.inf
    share = np.exp(scores - scores.max(-1, keepdims=True))
    wanted = share @ value / share.sum(-1, keepdims=True)
    for places in (1, 3, 7, 192):
        monkeypatch.setattr(decoder, "PLACES", places)
        assert np.allclose(decoder.attended(q[:, :, at], key, value, at), wanted, rtol=1e-11, atol=1e-12)


@pytest.mark.parametrize("size", [1.0, 300.0])
def test_scores_without_their_maximum(spark, size):
    config = decoder.Config(30, width=4, heads=2, layers=1, longest=20)
    weights = decoder.random_weights(config, 2)
    weights["token"] = weights["token"] * size
    ids = [1, 2, 3, 9, 8, 29, 7]
    row = decoder.score(spark.createDataFrame([(1, ids, [-100, -100, *ids[2:]])], "k int, input_ids array<int>, labels array<int>"), config, weights, "k").first()
    logits = decoder.Decoder(config, weights).logits(np.array([ids[:-1]]))[0, 1:]
    logs = logits - logits.max(-1, keepdims=True)
    logs -= np.log(np.exp(logs).sum(-1, keepdims=True))
    assert row["tokens"] == 5 and row["correct"] == int((logs.argmax(-1) == ids[2:]).sum()) and np.isclose(row["loss_sum"], -logs[np.arange(5), ids[2:]].sum(), rtol=1e-12)
