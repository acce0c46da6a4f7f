"""Leak-free splits by content hashes, and their audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vocab
from millrace.functions.exprs import digest_rank

SPLITS = ("train", "validation", "test")


def partition_counts(total: int, ratios: tuple[float, ...]) -> list[int]:
    """Whole numbers near total * ratio: what rounding down leaves goes to the largest fractions, the earlier of equals first."""
    if any(not math.isfinite(r) or r < 0 for r in ratios) or not math.isclose(sum(ratios), 1.0, rel_tol=0, abs_tol=1e-12):
        raise ValueError("ratios must be finite, not negative, and sum to 1")
    raw = [total * r for r in ratios]
    counts = [math.floor(x) for x in raw]
    for k in sorted(range(len(raw)), key=lambda k: (counts[k] - raw[k], k))[: total - sum(counts)]:
        counts[k] += 1
    return counts


def partition_columns(total: Column, ratios: tuple[float, ...]) -> list[Column]:
    """partition_counts of a column."""
    partition_counts(0, ratios)  # the ratios are checked
    raw = [total.cast("double") * r for r in ratios]
    whole = [F.floor(x) for x in raw]
    rest = [x - w for x, w in zip(raw, whole, strict=True)]
    left = total - sum(whole[1:], whole[0])
    out = []
    for i, own in enumerate(rest):
        ahead = [((other > own) if j > i else (other >= own)).cast("bigint") for j, other in enumerate(rest) if j != i]
        out.append(whole[i] + (sum(ahead, F.lit(0)) < left).cast("bigint"))
    return out


def assign(df: DataFrame, case: str, ratios: tuple[float, ...] = (0.8, 0.1, 0.1), seed: int = vocab.SEED, unique: bool = False) -> DataFrame:
    """Adds split: whole cases (equal ids) in the order of sha256(seed:id), cut at the ratios' counts. Rows follow their case. unique: each
    case is one row, which spares the join and the shuffle; such a table is read three times and best written before. The cases' number comes from
    the ranks' own bucket counts, in the same query."""
    if unique:
        return _cut(df, case, ratios, seed)
    cases = df.select(case).distinct()
    ranked = digest_rank(cases.withColumn("_digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(case)), 256)), "_digest", "_rank", total="_total")
    train, validation, _ = partition_columns(F.col("_total"), ratios)
    split = F.when(F.col("_rank") <= train, SPLITS[0]).when(F.col("_rank") <= train + validation, SPLITS[1]).otherwise(SPLITS[2])
    return df.join(ranked.withColumn("split", split).select(case, "split"), case)


def _cut(df: DataFrame, case: str, ratios: tuple[float, ...], seed: int) -> DataFrame:
    """assign of unique cases: rows stay where they are and are held against the digests at the counts' ranks. Those are found by the counts of buckets
    (65,536 at most), inside at most two of which digests are put in order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(case)), 256)
    digests = df.select(digest.alias("_digest")).filter("_digest is not null").withColumn("_bucket", F.substring("_digest", 1, 4))
    counts = digests.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ordered = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_bucket"))).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    train, validation, _ = partition_columns(F.col("_total"), ratios)
    ends = F.array(F.struct(F.lit(0).alias("_k"), train.alias("_end")), F.struct(F.lit(1).alias("_k"), (train + validation).alias("_end")))
    wanted = ordered.select("_bucket", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.explode(ends).alias("_e")).select("_bucket", "_before", "_upto", "_e.*")
    wanted = wanted.filter((F.col("_end") > F.col("_before")) & (F.col("_end") <= F.col("_upto"))).drop("_upto")
    inside = digests.join(F.broadcast(wanted), "_bucket").withColumn("_rank", F.row_number().over(Window.partitionBy("_k").orderBy("_digest")) + F.col("_before"))
    at = lambda k: F.coalesce(F.max(F.when((F.col("_k") == k) & (F.col("_rank") == F.col("_end")), F.col("_digest"))), F.lit(""))
    cuts = inside.agg(at(0).alias("_train"), at(1).alias("_validation"))  # one row; a count of 0 has no digest
    split = F.when(digest <= F.col("_train"), SPLITS[0]).when(digest <= F.col("_validation"), SPLITS[1]).otherwise(SPLITS[2])
    return df.crossJoin(F.broadcast(cuts)).filter(F.col(case).isNotNull()).withColumn("split", split).drop("_train", "_validation")


def template_splits(cases_with_split: DataFrame, held_out: str = vocab.HELD_OUT) -> DataFrame:
    """Cases to (case, family) rows: the held-out family only for test cases, the others in the case's own split."""
    seen = F.array_except(F.array(*map(F.lit, vocab.FAMILIES)), F.array(F.lit(held_out)))
    own = F.transform(seen, lambda f: F.struct(F.when(F.col("split") == "test", "test_seen_templates").otherwise(F.col("split")).alias("part"), f.alias("template_family")))
    extra = F.array(F.struct(F.lit("test_heldout_templates").alias("part"), F.lit(held_out).alias("template_family")))
    rows = F.when(F.col("split") == "test", F.concat(own, extra)).otherwise(own)
    return cases_with_split.withColumn("_row", F.explode(rows)).select("*", "_row.*").drop("_row")


def audit(rows: DataFrame, case: str = "semantic_case_id", part: str = "part", family: str = "template_family", row_id: str = "sample_id") -> DataFrame:
    """Counts that must all be 0: check, offenders."""
    test = ("test_seen_templates", "test_heldout_templates")
    group = F.when(F.col(part).isin(*test), "test").otherwise(F.col(part))
    seen = [F.max((F.col(part) == p).cast("int")) for p in test]
    per_case = rows.groupBy(case).agg(F.min(group).alias("low"), F.max(group).alias("high"), seen[0].alias("first"), seen[1].alias("second"))
    by_case = per_case.agg(F.count_if(F.col("low") != F.col("high")).alias("cases_in_several_splits"), F.count_if(F.col("first") != F.col("second")).alias("test_cases_not_in_both_views"))
    per_family = rows.groupBy(family).agg(F.max((F.col(part) == test[1]).cast("int")).alias("held"), F.max((F.col(part) != test[1]).cast("int")).alias("elsewhere"))
    by_family = per_family.agg(F.count_if((F.col("held") == 1) & (F.col("elsewhere") == 1)).alias("held_out_families_elsewhere"))
    repeated = rows.groupBy(row_id).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_rows"))
    one = by_case.crossJoin(by_family).crossJoin(repeated)  # a row each
    names = ["cases_in_several_splits", "test_cases_not_in_both_views", "held_out_families_elsewhere", "repeated_rows"]
    return one.unpivot([], names, "check", "offenders")
