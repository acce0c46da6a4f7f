"""Scores of predicted records against gold ones, row by row and split by split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import computed_once, share
from millrace.functions.vocab import FAMILIES, FIELDS
from millrace.operators.extract import field_stated

TOLERANCE, EXACT = 0.05, 1e-6


def compare(df: DataFrame, predicted: str = "parsed_") -> DataFrame:
    """Adds scores: an array of (field, mentioned, correct, hallucinated), and dim_*: comparable, count, exact, tolerant, error."""
    scores = []
    for field in FIELDS:
        said = field_stated(field)
        equal = F.col(predicted + field) == F.col(field)
        scores.append(F.struct(F.lit(field).alias("field"), said.cast("int").alias("mentioned"), (said & equal).cast("int").alias("correct"), (~said & field_stated(field, predicted)).cast("int").alias("hallucinated")))
    gold, found = F.col("dims"), F.col(predicted + "dims")
    comparable = gold.isNotNull()
    same = F.coalesce(comparable & found.isNotNull() & (F.size(found) == F.size(gold)), F.lit(False))
    errors = F.when(same, F.zip_with(found, gold, lambda x, y: F.abs(x - y)))
    within = lambda most: F.coalesce(F.forall(errors, lambda e: e <= most), F.lit(False)).cast("int")
    mean = F.aggregate(errors, F.lit(0.0), lambda a, e: a + e) / F.size(errors)
    return computed_once(df, {"scores": F.array(*scores), "dim_comparable": comparable.cast("int"), "dim_count": same.cast("int"), "dim_exact": within(EXACT), "dim_tolerant": within(TOLERANCE), "dim_error": mean})


def aligned(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Each predicted row beside its gold row, by key; what a zip of two tables of equal length would pair, whatever the rows' order. A key that only one
    side has, or that a side has twice, is an error: scores of unequal tables are never given."""
    def once(df: DataFrame, name: str) -> DataFrame:
        rest = F.struct(*[c for c in df.columns if c not in keys])
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.any_value(rest).alias(name))

    both = once(gold, "_gold").join(once(predicted, "_predicted"), keys, "full")  # each side is read once
    odd = (F.coalesce("_predicted_n", F.lit(0)) != 1) | (F.coalesce("_gold_n", F.lit(0)) != 1)
    named = F.concat(F.lit("rows of predictions and gold differ at "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    checked = both.withColumn("_paired", F.when(odd, F.raise_error(named).cast("boolean")).otherwise(F.lit(True)))
    return checked.filter("_paired").select(*keys, "_gold.*", "_predicted.*")


def field_rates(compared: DataFrame, by: str) -> DataFrame:
    """Accuracy and hallucinations of each field in each group (groups are never pooled)."""
    long = compared.select(by, F.explode("scores").alias("s")).select(by, "s.*")
    sums = long.groupBy(by, "field").agg(*[F.sum(c).alias(c) for c in ("mentioned", "correct", "hallucinated")], F.count(F.lit(1)).alias("n"))
    return sums.select(by, "field", "mentioned", "correct", "hallucinated", share(F.col("correct"), F.col("mentioned")).alias("accuracy"), share(F.col("hallucinated"), F.col("n") - F.col("mentioned")).alias("hallucination_rate"))


def split_rates(compared: DataFrame, by: str) -> DataFrame:
    """One row per group: micro totals over its rows, rates null where nothing is comparable. Needs matched_family, parsed_parseable."""
    total = lambda c: F.aggregate("scores", F.lit(0), lambda a, s: a + s[c])
    rows = compared.withColumns({c: total(c) for c in ("mentioned", "correct", "hallucinated")})
    sums = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in ("mentioned", "correct", "hallucinated", "dim_comparable", "dim_count", "dim_exact", "dim_tolerant")],
        F.sum(F.col("parsed_parseable").cast("int")).alias("parseable"),
        F.count("matched_family").alias("in_family"),
        F.avg("dim_error").alias("dim_mean_error"),
    )
    return sums.select(
        by,
        "n",
        share(F.col("parseable"), F.col("n")).alias("parseable_rate"),
        share(F.col("in_family"), F.col("n")).alias("any_family_rate"),
        "mentioned",
        share(F.col("correct"), F.col("mentioned")).alias("mentioned_accuracy"),
        share(F.col("hallucinated"), F.col("n") * len(FIELDS) - F.col("mentioned")).alias("hallucination_rate"),
        "dim_comparable",
        share(F.col("dim_exact"), F.col("dim_comparable")).alias("dim_exact_rate"),
        share(F.col("dim_tolerant"), F.col("dim_comparable")).alias("dim_tolerant_rate"),
        F.round("dim_mean_error", 9).alias("dim_mean_error"),
    )


def family_counts(compared: DataFrame, by: str) -> DataFrame:
    """Rows of each family in each group, families without rows and "none" as well."""
    names = [*FAMILIES, "none"]
    return compared.groupBy(by).agg(*[F.sum((F.coalesce("matched_family", F.lit("none")) == f).cast("int")).alias(f) for f in names]).unpivot([by], names, "family", "n")


def deltas(primary: DataFrame, reference: DataFrame, by: str) -> DataFrame:
    """Differences of long tables (by, metric, value) on group and metric; null where either lacks a number."""
    return primary.select(by, "metric", F.col("value").alias("a")).join(reference.select(by, "metric", F.col("value").alias("b")), [by, "metric"], "left").select(by, "metric", (F.col("a") - F.col("b")).alias("delta"))
