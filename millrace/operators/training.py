"""What a training loop computes about its data and time: batches, weights, rates, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import digest_rank, ordered_rank, share


def batch_stream(df: DataFrame, key: str, epochs: int, batch: int, seed: int, start: int = 0) -> DataFrame:
    """Adds epoch, position, batch and slot: each epoch is a permutation by hashes, and batches run on over its end.

    start: the first batch to return; a stream resumed there goes on as it would have.
    """
    total = df.count()
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("_digest", F.sha2(F.concat((F.col("epoch") + seed).cast("string"), F.lit(":"), F.col(key).cast("string")), 256))
    ranked = digest_rank(rows, "_digest", "position", ["epoch"]).drop("_digest")
    index = F.col("epoch") * F.lit(total) + F.col("position") - 1
    out = ranked.withColumn("batch", F.floor(index / batch).cast("bigint")).withColumn("slot", (index % batch).cast("bigint"))
    return out.filter(F.col("batch") >= start) if start else out


def padding(batches: DataFrame, length: str) -> DataFrame:
    """Each batch's longest row, tokens, padded size and the share that is padding."""
    sums = batches.groupBy("batch").agg(F.max(length).alias("longest"), F.sum(length).alias("tokens"), F.count(F.lit(1)).alias("n"))
    cells = F.col("longest") * F.col("n")
    return sums.select("batch", "n", "longest", "tokens", cells.alias("cells"), (1 - share(F.col("tokens"), cells)).alias("padding_share"))


def step_weights(batches: DataFrame, tokens: str, accumulated: int) -> DataFrame:
    """Micro-batches to steps: each one's share of its step's tokens weighs its loss."""
    sums = batches.groupBy("batch").agg(F.sum(tokens).alias("tokens")).withColumn("step", F.floor(F.col("batch") / accumulated).cast("bigint"))
    return sums.withColumn("weight", share(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("step"))))


def rate(step: Column, most: float, least: float, warmup: int, last: int) -> Column:
    """Linear warm-up, then a cosine down to the least rate, which also holds from the last step on."""
    out = F.when(F.lit(warmup > 0) & (step < warmup), (step + 1) * most / max(warmup, 1)).when(step >= last, least)
    if last == warmup:
        return out.otherwise(least)
    return out.otherwise(least + (most - least) * 0.5 * (1 + F.cos(F.pi() * (step - warmup) / (last - warmup))))


def schedule(spark: SparkSession, most: float, least: float, warmup: int, last: int, every: int) -> DataFrame:
    """step, learning rate, and whether a step is due (each every-th and the last)."""
    steps = spark.range(0, last + 1).withColumnRenamed("id", "step")
    due = (F.col("step") > 0) & ((F.col("step") % every == 0) | (F.col("step") == last))
    return steps.select("step", rate(F.col("step").cast("double"), most, least, warmup, last).alias("learning_rate"), due.alias("due"))


def weighted_mean(df: DataFrame, by: str, loss: str, tokens: str, correct: str) -> DataFrame:
    """Loss and accuracy weighted by target tokens."""
    return df.groupBy(by).agg(share(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens)).alias("loss"), share(F.sum(correct), F.sum(tokens)).alias("accuracy"), F.sum(tokens).alias("tokens"))


def best(df: DataFrame, by: str, name: str, value: str, eligible: Column) -> DataFrame:
    """The variant of the highest value among eligible ones; of equals the least name."""
    return df.filter(eligible).groupBy(by).agg(F.max_by(name, F.struct(F.col(value), -F.col(name))).alias(name), F.max(value).alias(value))


def new_minima(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows that go below all before them in their group."""
    before = F.min(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(value) < F.col("_before"))).drop("_before")


def first_failures(df: DataFrame, by: str, failed: Column, order: str, shown: int = 8) -> DataFrame:
    """Each group's first failures in order, with the group's number of failures."""
    own = df.filter(failed)
    return first_rows(own, by, order, shown).join(own.groupBy(by).agg(F.count(F.lit(1)).alias("failures")), by)


def first_rows(df: DataFrame, by: str, order: str, shown: int) -> DataFrame:
    """Each group's first rows in order. Only a rank that is cut is asked for, so each partition sends on its own first rows of a group, and no more."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_rank") <= shown).drop("_rank")


def sequential_batches(df: DataFrame, key: str, batch: int) -> DataFrame:
    """Adds position, batch and slot in the order of a whole-number key, for evaluation: batches of a fixed size, the last one may be smaller."""
    ranked = ordered_rank(df, key, "position")
    return ranked.withColumn("batch", F.floor((F.col("position") - 1) / batch).cast("bigint")).withColumn("slot", F.pmod(F.col("position") - 1, F.lit(batch)).cast("bigint"))
