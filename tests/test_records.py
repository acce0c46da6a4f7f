import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.operators import constraints, extract, qc, render, score, service, split, stats
from millrace.sources import cases

BASE = {"location_side": "left", "location_segment": "upper", "composition": "solid", "echogenicity": "hypoechoic", "shape": "wider_than_tall", "margin": "smooth", "echogenic_foci": "none", "vascularity": "peripheral", "lymph_nodes": "no_suspicious", "dims": [9.0, 6.5], "dims_state": None}
SCHEMA = ", ".join(f"{f} string" for f in vocab.FIELDS) + ", dims array<double>, dims_state string"


def exam(spark, *changes):
    names = [*vocab.FIELDS, "dims", "dims_state"]
    return spark.createDataFrame([tuple((BASE | c)[n] for n in names) for c in changes or ({},)], SCHEMA)


@pytest.mark.parametrize(
    "change,rules",
    [
        ({}, []),
        ({"echogenicity": "anechoic", "vascularity": "none"}, ["composition.non_cystic_anechoic"]),
        ({"composition": "cystic"}, ["composition.cystic_echogenicity"]),
        ({"composition": "cystic", "echogenicity": "anechoic", "echogenic_foci": "macrocalcification"}, ["composition.cystic_echogenic_foci", "echogenicity.anechoic_echogenic_foci"]),
        ({"composition": "spongiform", "echogenicity": "very_hypoechoic"}, ["composition.spongiform_echogenicity"]),
        ({"composition": "spongiform", "vascularity": "mixed", "margin": "lobulated_or_irregular"}, ["composition.spongiform_vascularity", "composition.spongiform_margin"]),
        ({"dims": None, "dims_state": "not_applicable", "vascularity": "not_applicable"}, ["dimensions.not_applicable", "vascularity.not_applicable"]),
        ({"dims": [9.0, 2.5]}, ["dimensions.below_synthetic_minimum", "dimensions.extreme_ratio"]),
        ({"dims": [6.0, 9.0]}, ["shape.wider_than_tall_mismatch"]),
        ({"shape": "taller_than_wide", "dims": [9.0, 9.0]}, ["shape.taller_than_wide_mismatch"]),
        ({"dims": None, "dims_state": "unknown", "shape": "taller_than_wide"}, []),
    ],
)
def test_constraints(spark, change, rules):
    assert exam(spark, change).select(constraints.violations().alias("v")).first()["v"] == rules


def test_checked_raises(spark):
    bad = exam(spark, {"dims": [6.0, 9.0]}).select(constraints.checked(F.col("shape"), constraints.violations()).alias("x"))
    with pytest.raises(PySparkException, match="wider_than_tall_mismatch"):
        bad.collect()


def test_schema_violations(spark):
    rows = exam(spark, {}, {"location_side": "isthmus"}, {"location_segment": "not_applicable"}, {"dims": [1.0]}, {"dims": [1.0, -2.0]}, {"dims_state": "unknown"}, {"margin": "odd"})
    found = [r["v"] for r in rows.select(cases.schema_violations().alias("v")).collect()]
    assert found == [[], ["location.isthmus_segment"], ["location.lobe_segment"], ["dimensions.count"], ["dimensions.positive"], ["dimensions.union"], ["domain.margin"]]


def test_canonical_json(spark):
    row = cases.identified(exam(spark)).first()
    assert row["input"] == '{"lymph_nodes":"no_suspicious","nodules":[{"composition":"solid","dimensions_mm":[9.0,6.5],"echogenic_foci":"none","echogenicity":"hypoechoic","location":{"segment":"upper","side":"left"},"margin":"smooth","nodule_id":"n1","shape":"wider_than_tall","vascularity":"peripheral"}],"organ":"thyroid","schema_version":"1.0.0"}'
    again = cases.parse_json(spark.createDataFrame([(row["input"],), ('{"nodules":[{"location":{"side":"left"},"dimensions_mm":"unknown"}]}',)], "input string")).collect()
    assert again[0]["dims"] == [9.0, 6.5] and again[0]["margin"] == "smooth"
    assert again[1]["dims"] is None and again[1]["dims_state"] == "unknown" and again[1]["margin"] == "not_mentioned"


def test_same_seed_same_cases(spark):
    draw = lambda seed: cases.identified(cases.draw_exams(cases.attempts(spark, 500), seed)).select("semantic_case_id", "input")
    assert draw(1).exceptAll(draw(1)).isEmpty() and not draw(1).exceptAll(draw(2)).isEmpty()
    broken = cases.draw_exams(cases.attempts(spark, 5000)).filter((F.size(constraints.violations()) > 0) | (F.size(cases.schema_violations()) > 0))
    assert broken.isEmpty()


def test_reports(spark):
    rows = render.fragments(exam(spark, {}, {"location_side": "isthmus", "location_segment": "not_applicable", "dims": None, "dims_state": "unknown", "composition": "unknown", "echogenicity": "not_mentioned", "lymph_nodes": "unknown", "margin": "unknown", "echogenic_foci": "unknown", "vascularity": "unknown", "shape": "unknown"}))
    full, bare = rows.select(*[render.report(f).alias(f) for f in vocab.FAMILIES]).collect()
    assert full["location_first_v2"] == "甲状腺左叶上部见一枚实性低回声结节，大小约9×6.5mm，呈非高于宽形，边缘光滑，内未见明显强回声，CDFI示周边可见血流信号。颈部未见明显可疑淋巴结。"
    assert full["dimensions_first_v2"].startswith("一枚约9×6.5mm的实性低回声结节位于甲状腺左叶上部，内未见明显强回声")
    assert bare["dimensions_first_v2"] == "一枚结节位于甲状腺峡部。" and bare["flow_first_v2"] == "甲状腺峡部探及一枚结节。"
    with pytest.raises(PySparkException, match="unknown template family"):
        rows.select(render.rendered(F.lit("other"))).collect()
    with pytest.raises(ValueError):
        render.render_cases(rows, ["nope"])


@pytest.mark.parametrize(
    "text,field,value",
    [
        ("右侧叶中段可见囊实混合结节", "composition", "mixed_cystic_solid"),
        ("结节呈极低回声", "echogenicity", "very_hypoechoic"),
        ("结节横向生长，非高于宽", "shape", "wider_than_tall"),
        ("前后径大于横径", "shape", "taller_than_wide"),
        ("内部及周边可见血流", "vascularity", "mixed"),
        ("左叶与峡部交界", "location_side", "isthmus"),
        ("左叶与峡部交界", "location_segment", "not_applicable"),
        ("大小约1.2×0.8cm", "dims", [12.0, 8.0]),
        ("大小约12 mm × 8 mm × 7 mm", "dims", [12.0, 8.0, 7.0]),
        ("12X8，具体大小无法测量", "dims", None),
        ("　 \n", "parseable", False),
        ("颈部", "parseable", False),
        ("甲状腺", "parseable", True),
        ("0×5mm 结节", "invalid", True),
        ("左叶上部", "explicit", 2),
        ("峡部", "explicit", 1),
    ],
)
def test_extract(spark, text, field, value):
    assert extract.extract(spark.createDataFrame([(text,)], "t string"), "t").first()[f"parsed_{field}"] == value


def test_scores(spark):
    rows = render.fragments(exam(spark, {}, {"dims": [9.0, 6.0, 7.0], "margin": "not_mentioned"})).withColumn("by", F.lit("x"))
    texts = F.array(F.lit("左叶上部实性低回声，9.02×6.5mm，边缘光滑"), F.lit("左叶上部实性低回声，9×6mm，边缘光滑"))
    rows = rows.withColumn("p", F.when(F.size("dims") == 2, texts[0]).otherwise(texts[1]))
    out = score.compare(extract.extract(rows, "p")).withColumn("matched_family", render.matched_family(F.col("p")))
    first, second = out.orderBy(F.size("dims")).collect()
    assert (first["dim_exact"], first["dim_tolerant"], round(first["dim_error"], 6)) == (0, 1, 0.01)
    assert (second["dim_count"], second["dim_error"]) == (0, None)
    assert [s["hallucinated"] for s in second["scores"] if s["field"] == "margin"] == [1]
    rates = score.split_rates(out, "by").first()
    assert rates["any_family_rate"] == 0 and rates["dim_tolerant_rate"] == 0.5
    assert score.family_counts(out, "by").filter("family = 'none'").first()["n"] == 2


def test_qc(spark):
    good = render.fragments(exam(spark)).withColumn("report", render.report("location_first_v2"))
    assert qc.run_qc(good, "report").first()["findings"] == []
    cases_ = {
        "": ["QC.EMPTY_REPORT"],
        "今天天气": None,
        "甲状腺右叶上部见一枚实性低回声结节，大小约9×6.5mm": ["QC.TEXT_LOCATION_MISMATCH"],
        "甲状腺左叶上部见一枚实性低回声结节，大小约9×6.5mm（约1.0cm），良性": ["QC.DIAGNOSTIC_LANGUAGE", "QC.UNIT_MIXED_MM_CM"],
    }
    for text, rules in cases_.items():
        found = [f["rule_id"] for f in qc.run_qc(exam(spark).withColumn("report", F.lit(text)), "report").first()["findings"]]
        assert found[0] == "QC.UNPARSEABLE_REPORT" if rules is None else found[: len(rules)] == rules
    mislabel = qc.run_qc(render.fragments(exam(spark, {"vascularity": "none"})).withColumn("report", render.report("location_first_v2")).withColumn("vascularity", F.lit("not_mentioned")), "report").first()
    assert [f["rule_id"] for f in mislabel["findings"]] == ["QC.STRUCTURE_NEGATION_MISLABEL"] and mislabel["passed"]


def test_every_defect_is_found(spark):
    rows = cases.identified(cases.draw_exams(cases.attempts(spark, 400)))
    rows = render.fragments(rows).withColumn("report", render.report("location_first_v2"))
    found = {r["defect_id"]: r for r in qc.recall(qc.run_qc(qc.inject(rows, "report", "attempt", 20), "report")).collect()}
    assert set(found) == set(vocab.DEFECTS) and all(r["support"] > 0 for r in found.values())
    assert all(r["recall"] == 1 for r in found.values()) and found["unit_mixed"]["macro_recall"] == 1


def test_service(spark):
    rows = render.fragments(exam(spark, {}, {"lymph_nodes": "suspicious"})).withColumn("report", render.report("location_first_v2"))
    out = service.extract(rows.select("report")).collect()
    assert all(r["passed"] and r["composition"] == "solid" for r in out)
    made = service.generate(rows.withColumn("p", F.lit("")).withColumn("e", F.lit("failed")), "p", "e", fallback=False).first()
    assert made["used_fallback"] and made["report"] == "" or made["report"] is not None
    assert service.info()["schema_version"] == "1.0.0"


def test_thirty_cases(spark):
    rows = spark.createDataFrame([(f"case{k % 30}", k) for k in range(90)], "c string, k int")
    counts = {r["split"]: r["n"] for r in split.assign(rows, "c").groupBy("split").agg(F.count_distinct("c").alias("n")).collect()}
    assert counts == {"train": 24, "validation": 3, "test": 3}
    assert split.partition_counts(7, (0.8, 0.1, 0.1)) == [5, 1, 1] and split.partition_counts(0, (1.0, 0.0, 0.0)) == [0, 0, 0]
    with pytest.raises(ValueError):
        split.partition_counts(3, (0.5, 0.1, 0.1))


def test_audit_finds_leaks(spark):
    rows = spark.createDataFrame([("a", "train", "f", "1"), ("a", "test_seen_templates", "f", "2"), ("b", "test_heldout_templates", "f", "2")], "semantic_case_id string, part string, template_family string, sample_id string")
    assert {r["check"]: r["offenders"] for r in split.audit(rows).collect()} == {"cases_in_several_splits": 1, "test_cases_not_in_both_views": 2, "held_out_families_elsewhere": 1, "repeated_rows": 1}


def test_integrity_of_untouched_rows(spark):
    rows = render.render_cases(cases.unique_cases(cases.identified(cases.draw_exams(cases.attempts(spark, 200)))))
    assert stats.integrity(rows).filter(F.size("problems") > 0).isEmpty()


def test_integrity_of_odd_rows(spark):
    """Odd JSON is read as path by path; rows aren't shuffled, and a case with several inputs is found."""
    good = cases.identified(exam(spark)).first()["input"]
    odd = [good, "", "{", "[]", f"[{good}]", "null", None, good[:-9], " \n" + good, good.replace("smooth", "  "), good.replace('"smooth"', "null"), good.replace('"smooth"', "7"), good.replace('"smooth"', "[1, 2]"), good.replace("[9.0,6.5]", "[ 9, 6.50 ]"), good.replace("[9.0,6.5]", '"unknown"'), good.replace("[9.0,6.5]", "5"), good.replace('"nodules"', '"n"'), good.replace('{"segment":"upper","side":"left"}', '"left"'), '{"nodules":[],"schema_version":2}', '{"nodules":{"margin":"smooth"},"lymph_nodes":"unknown"}']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, input string")
    at = lambda path: F.get_json_object("input", path)
    paths = {f: f"$.nodules[0].{f}" for f in vocab.FIELDS} | {"location_side": "$.nodules[0].location.side", "location_segment": "$.nodules[0].location.segment", "lymph_nodes": "$.lymph_nodes"}
    dims = at("$.nodules[0].dimensions_mm")
    listed = F.from_json(F.when(dims.startswith("["), dims), "array<double>")
    wanted = rows.select("k", *[F.regexp_replace(F.coalesce(at(p), F.lit("not_mentioned")), " ", "").alias(f) for f, p in paths.items()], listed.alias("dims"), F.when(listed.isNull(), F.coalesce(dims, F.lit("not_mentioned"))).alias("dims_state"), at("$.schema_version").alias("v"))
    found = cases.parse_json(rows, version="v").select("k", *[F.regexp_replace(f, " ", "").alias(f) for f in paths], "dims", "dims_state", "v")
    assert found.orderBy("k").collect() == wanted.orderBy("k").collect()

    made = render.render_cases(cases.identified(exam(spark, {}, {"margin": "ill_defined"})))
    first, second = sorted({(r["semantic_case_id"], r["input"]) for r in made.collect()})
    twisted = made.withColumn("input", F.when((F.col("semantic_case_id") == first[0]) & (F.col("template_family") == vocab.HELD_OUT), F.lit(second[1])).otherwise(F.col("input")))
    checked = stats.integrity(twisted)
    assert {(r["semantic_case_id"] == first[0], "case_has_several_inputs" in r["problems"]) for r in checked.collect()} == {(True, True), (False, False)}
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "get_json_object" not in plan
    nulls = stats.integrity(made.withColumn("semantic_case_id", F.lit(None).cast("string"))).collect()
    assert len(nulls) == 8 and all("case_has_several_inputs" in r["problems"] for r in nulls)
