"""The three tasks as functions from tables to tables: extract, check, generate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.operators import extract as rules
from millrace.operators import qc
from millrace.operators.render import fragments, report


def info() -> dict[str, str]:
    return {"schema_version": vocab.SCHEMA_VERSION, "generator_version": vocab.GENERATOR_VERSION, "renderer_version": vocab.RENDERER_VERSION}


def extract(reports: DataFrame, text: str = "report") -> DataFrame:
    """Reports to records (the record's own columns) with findings of the report held against that record."""
    found = rules.extract(reports, text)
    fields = [*vocab.FIELDS, "dims", "dims_state"]
    own = found.select(*reports.columns, *[F.col("parsed_" + f).alias(f) for f in fields])
    return qc.run_qc(own, text, prefix="again_").drop(*[f"again_{f}" for f in (*fields, "invalid", "explicit")]).withColumnRenamed("again_parseable", "parseable")


def check(reports: DataFrame, text: str = "report", with_record: bool = True) -> DataFrame:
    return qc.run_qc(reports, text, with_record)


def generate(records: DataFrame, prediction: str, error: str | None = None, fallback: bool = True) -> DataFrame:
    """A report for each record: the prediction, or where it failed (an error, or errors found in it) the template's report.

    used_fallback says where that was so, even if no fallback is wanted; the report is then empty on an error.
    """
    rows = records if "parts" in records.columns else fragments(records)
    checked = qc.run_qc(rows, prediction)
    failed = F.lit(False) if error is None else F.col(error).isNotNull()
    bad = failed | ~F.col("passed")
    text = F.when(bad, report("location_first_v2")) if fallback else F.when(failed, "")
    return checked.withColumn("used_fallback", bad if fallback else failed).withColumn("report", text.otherwise(F.col(prediction)))
