"""Challenge sets: ids, checks, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.functions.exprs import contains_any, content_id, strip
from millrace.operators.constraints import violations
from millrace.operators.render import fragments, matched_family


def validate(rows: DataFrame, frozen_cases: DataFrame, frozen_reports: DataFrame | None = None) -> DataFrame:
    """Adds challenge_id and problems. rows: records with semantic_case_id and reference_report; frozen_*: semantic_case_id
    and reference_report of the training release. Leaks are found by joins that keep the row once."""
    rows = rows if "parts" in rows.columns else fragments(rows)
    report = F.col("reference_report")
    rows = rows.withColumn("challenge_id", content_id("challenge_", F.concat(F.lit(f"{vocab.CHALLENGE_VERSION}:"), F.col("semantic_case_id"), F.lit(":"), report)))
    out = rows.join(frozen_cases.select("semantic_case_id").distinct().withColumn("_case_leaks", F.lit(True)), "semantic_case_id", "left")
    if frozen_reports is None:
        out = out.withColumn("_report_leaks", F.lit(False))
    else:
        out = out.join(frozen_reports.select("reference_report").distinct().withColumn("_report_leaks", F.lit(True)), "reference_report", "left")
    tests = {
        "empty_report": strip(report) == "",
        "diagnostic_language": contains_any(report, vocab.CHALLENGE_DIAGNOSTIC),
        "template_duplicate": matched_family(report).isNotNull(),
        "constraints": F.size(violations()) > 0,
        "leaked_case": F.coalesce("_case_leaks", F.lit(False)),
        "leaked_report": F.coalesce("_report_leaks", F.lit(False)),
    }
    return out.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]))).drop("_case_leaks", "_report_leaks")


def repeated(rows: DataFrame) -> DataFrame:
    """Ids, cases and reports that come more than once, and rows whose tags are empty or repeated: check, value, n."""
    out = None
    for column in ("challenge_id", "semantic_case_id", "reference_report"):
        found = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit(column).alias("check"), "value", "n")
        out = found if out is None else out.unionByName(found)
    if "difficulty_tags" in rows.columns:
        bad = rows.filter((F.size("difficulty_tags") < 1) | (F.size(F.array_distinct("difficulty_tags")) != F.size("difficulty_tags")))
        out = out.unionByName(bad.select(F.lit("difficulty_tags").alias("check"), F.col("challenge_id").alias("value"), F.lit(1).cast("bigint").alias("n")))
    return out
