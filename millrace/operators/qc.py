"""Quality control of reports: an ordered array of findings, injected defects, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.functions.exprs import ascii_digits, clip, computed_once, contains_any, first_match, replace_first, share, strip
from millrace.operators.constraints import violations
from millrace.operators.extract import extract, field_stated
from millrace.operators.score import TOLERANCE
from millrace.operators.training import first_rows
from millrace.sources.sinks import materialized

FINDING = "struct<rule_id:string,severity:string,field:string,evidence:string>"


def finding(rule: str, severity: str, field: str | None = None, evidence: Column | None = None) -> Column:
    text = F.lit(None) if evidence is None else evidence
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(field).cast("string").alias("field"), text.cast("string").alias("evidence")).cast(FINDING)


def text_findings(body: Column, parseable: Column, short: Column | None = None) -> list[Column]:
    """Findings from the text alone, in order; null where a rule doesn't fire. short: the text as evidence, if it is known."""
    short = clip(body) if short is None else short
    out = [F.when(body.contains(t), finding("QC.DIAGNOSTIC_LANGUAGE", "error", None, F.lit(t))) for t in vocab.DIAGNOSTIC]
    contradictions = {
        "location_side": body.contains("左叶") & body.contains("右叶"),
        "shape": body.contains("非高于宽") & contains_any(body, ("呈高于宽", "前后径超过横径")),
        "echogenicity": body.contains("实性") & body.contains("无回声") & ~body.contains("囊"),
    }
    out += [F.when(c, finding("QC.TEXT_FIELD_CONTRADICTION", "error", f, short)) for f, c in contradictions.items()]
    units = F.lower(body)  # both units must be named at all before the patterns look for them
    out.append(F.when(units.contains("mm") & units.contains("cm") & body.rlike(vocab.MM_MEASURE) & body.rlike(vocab.CM_MEASURE), finding("QC.UNIT_MIXED_MM_CM", "warning", "dimensions_mm", short)))
    out.append(F.when(~parseable, finding("QC.UNPARSEABLE_REPORT", "error")))
    return out


def record_findings(body: Column, prefix: str, short: Column | None = None) -> list[Column]:
    """Findings from the text held against the row's record."""
    short = clip(body) if short is None else short
    found, gold = F.col(prefix + "dims"), F.col("dims")
    differs = lambda f: F.col(prefix + f) != F.col(f)
    out = [F.when(field_stated("location_side") & differs("location_side"), finding("QC.TEXT_LOCATION_MISMATCH", "error", "location_side", short))]
    close = (F.size(found) == F.size(gold)) & F.forall(F.zip_with(found, gold, lambda x, y: F.abs(x - y) <= TOLERANCE), lambda ok: F.coalesce(ok, F.lit(False)))
    out.append(F.when(gold.isNotNull() & ~F.coalesce(found.isNotNull() & close, F.lit(False)), finding("QC.TEXT_DIMENSION_MISMATCH", "error", "dimensions_mm", short)))
    for field, (rule, severity) in vocab.OMISSIONS.items():
        wrong = finding("QC.TEXT_FIELD_VALUE_MISMATCH", "error", field, short)
        out.append(F.when(field_stated(field) & differs(field), F.when(field_stated(field, prefix), wrong).otherwise(finding(rule, severity, field, short))))
    for field, phrases in (("vascularity", vocab.NEGATIVE_VASCULARITY), ("echogenic_foci", vocab.NEGATIVE_FOCI)):
        out.append(F.when((F.col(field) == "not_mentioned") & contains_any(body, phrases), finding("QC.STRUCTURE_NEGATION_MISLABEL", "warning", field)))
    return out


def run_qc(df: DataFrame, text: str, with_record: bool = True, prefix: str = "parsed_") -> DataFrame:
    """Adds findings, error_count, warning_count and passed. An empty report has one finding and no others."""
    out = computed_once(extract(df, text, prefix), {"_body": strip(F.col(text))})
    body = F.col("_body")
    out = computed_once(out, {"_short": clip(body)})
    short = F.col("_short")
    found = text_findings(body, F.col(prefix + "parseable"), short) + (record_findings(body, prefix, short) if with_record else [])
    findings = F.array_compact(F.array(*found))
    if with_record:
        broken = F.transform(violations(), lambda v: F.struct(F.lit("QC.STRUCTURE_INTERNAL_CONSISTENCY").alias("rule_id"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("field"), v.alias("evidence")).cast(FINDING))
        findings = F.concat(findings, broken)
    out = computed_once(out, {"findings": F.when(body == "", F.array(finding("QC.EMPTY_REPORT", "error"))).otherwise(findings)}).drop("_body", "_short")
    count = lambda s: F.size(F.filter("findings", lambda f: f["severity"] == s))
    return out.withColumn("error_count", count("error")).withColumn("warning_count", count("warning")).withColumn("passed", F.col("error_count") == 0)


def has_rule(rule: Column | str) -> Column:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.exists("findings", lambda f: f["rule_id"] == rule)


def clean_rollup(checked: DataFrame, by: str, example: str, shown: int = 8) -> DataFrame:
    """Pass rate, mean errors and warnings of clean pairs, and the first rows (by example) that wrongly failed."""
    slim = materialized(checked.select(by, example, "passed", "error_count", "warning_count"))  # read twice: once to count, once for the few rows shown
    rates = slim.groupBy(by).agg(F.count(F.lit(1)).alias("n"), share(F.sum(F.col("passed").cast("int")), F.count(F.lit(1))).alias("pass_rate"), F.avg("error_count").alias("mean_errors"), F.avg("warning_count").alias("mean_warnings"), F.sum((~F.col("passed")).cast("int")).alias("false_errors"))
    first = first_rows(slim.filter(~F.col("passed")).select(by, example), by, example, shown).groupBy(by).agg(F.sort_array(F.collect_list(example)).alias("first_failures"))
    return rates.join(first, by, "left").withColumn("first_failures", F.coalesce("first_failures", F.array().cast(first.schema["first_failures"].dataType)))


def first_phrase(body: Column, phrases: tuple[str, ...]) -> Column:
    return first_match(body, [(p, (p,)) for p in phrases], "")


def mutations(body: Column) -> dict[str, Column]:
    """Each defect's text; null where it can't be injected."""
    out = {}
    for defect, (_, phrases) in vocab.DEFECTS.items():
        if phrases:
            phrase = first_phrase(body, phrases)
            out[defect] = F.when(phrase != "", replace_first(body, phrase, ""))
    number = F.regexp_extract(body, vocab.NUMBER, 0)
    out["dimension_mismatch"] = F.when(F.col("dims").isNotNull() & (number != ""), replace_first(body, number, (ascii_digits(number).try_cast("double") + 5).cast("string")))
    left, right = body.contains("左叶"), body.contains("右叶")
    out["laterality_mismatch"] = F.when(left & ~right, F.replace(body, F.lit("左叶"), F.lit("右叶"))).when(right & ~left, F.replace(body, F.lit("右叶"), F.lit("左叶")))
    out["unit_mixed"] = F.when(body.contains("mm"), replace_first(body, "mm", "mm（约1.0cm）"))
    out["text_contradiction"] = F.when(left, F.concat(body, F.lit("同时可见右叶结节。"))).when(right, F.concat(body, F.lit("同时可见左叶结节。")))
    out["negation_mislabeled"] = F.when((F.col("vascularity") == "none") & body.contains("未见明显血流"), body)
    out["diagnostic_language"] = F.concat(body, F.lit("考虑恶性可能。"))
    return {d: out[d] for d in vocab.DEFECTS}


def inject(df: DataFrame, text: str, example: str, per_defect: int | None = None) -> DataFrame:
    """A row for each defect that fits: defect_id, expected_rule, the mutated text and record; the first per_defect by example."""
    if per_defect is not None:  # ids and defects alone say which rows are asked for; those rows are then the only ones that go on
        fits = F.array_compact(F.array(*[F.when(m.isNotNull(), F.lit(d)) for d, m in mutations(F.col(text)).items()]))
        pairs = materialized(df.select(F.col(example).alias("_id"), F.explode(fits).alias("_defect")))
        first = materialized(first_rows(pairs, "_defect", "_id", per_defect).select("_id").distinct())
        df = df.join(F.broadcast(first), F.col(example) == F.col("_id"), "left_semi")
    made = F.array(*[F.struct(F.lit(d).alias("defect_id"), F.lit(vocab.DEFECTS[d][0]).alias("expected_rule"), m.alias("mutated")) for d, m in mutations(F.col(text)).items()])
    rows = df.withColumn("_made", F.explode(made)).select("*", "_made.*").drop("_made").filter("mutated is not null")
    rows = rows.withColumn("vascularity", F.when(F.col("defect_id") == "negation_mislabeled", "not_mentioned").otherwise(F.col("vascularity")))
    if per_defect is not None:
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("defect_id").orderBy(example))).filter(F.col("_rank") <= per_defect).drop("_rank")
    return rows.withColumn(text, F.col("mutated")).drop("mutated")


def every_defect(injected: DataFrame) -> DataFrame:
    """The injected rows, or an error that names the defects without any."""
    there = {r["defect_id"] for r in injected.select("defect_id").distinct().collect()}  # as many as there are kinds
    if missing := [d for d in vocab.DEFECTS if d not in there]:
        raise ValueError(f"no row for defects: {missing}")
    return injected


def recall(checked: DataFrame) -> DataFrame:
    """Support, detected and recall of each defect, beside micro and macro recall over all."""
    each = checked.withColumn("hit", has_rule(F.col("expected_rule")).cast("int")).groupBy("defect_id", "expected_rule").agg(F.count(F.lit(1)).alias("support"), F.sum("hit").alias("detected"))
    each = each.withColumn("recall", share(F.col("detected"), F.col("support")))
    over = each.agg(share(F.sum("detected"), F.sum("support")).alias("micro_recall"), F.avg("recall").alias("macro_recall"))
    return each.crossJoin(F.broadcast(over))  # one row
