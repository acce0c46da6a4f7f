"""Scans: driver tables in parquet, records and samples in JSON lines."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import utc_stamp

#: Schemas of the JSON-lines releases. JSON is read strictly: a row that doesn't fit is an error.
GENERATED = "sample_id string, semantic_case_id string, task string, input string, target string, template_family string, generator_version string, renderer_version string, schema_version string, seed bigint, source string"
CHALLENGE = "challenge_id string, semantic_case_id string, input string, reference_report string, difficulty_tags array<string>, schema_version string, challenge_version string, authoring_method string, source string"
FIXTURE = "sample_id string, structure struct<nodules: array<struct<nodule_id: string, location: struct<side: string, segment: string>, dimensions_mm: string, composition: string, echogenicity: string, shape: string, margin: string, echogenic_foci: string, vascularity: string>>, lymph_nodes: string>, report string"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out evenly (a small file of one part); any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def task_count(df: DataFrame, rows: int = 100_000) -> int:
    """How many tasks a scan's rows are dealt to, so that a task's memory is bounded however large the table is (parquet counts its rows itself)."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def dealt(df: DataFrame) -> DataFrame:
    """Rows that cost much each, dealt out evenly to four tasks a core: partitions that adaptive execution joins by their bytes would leave most cores idle."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = rows.filter(F.to_json(F.struct(*rows.columns)) != "")  # every column is read, so that every row is checked
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def first_rows(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    """A limit over a stated order, or all rows."""
    return df if limit is None else df.orderBy(order).limit(limit)


def generated(spark: SparkSession, path: str, split: str, limit: int | None = None) -> DataFrame:
    """Generated samples as evaluation examples: example_id, split, semantic_case_id, input, reference_text."""
    rows = first_rows(_lines(spark, path, GENERATED), "sample_id", limit)
    return rows.select(F.col("sample_id").alias("example_id"), F.lit(split).alias("split"), "semantic_case_id", "input", F.col("target").alias("reference_text"))


def challenge(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Challenge rows as evaluation examples; their tags stay an array."""
    rows = first_rows(_lines(spark, path, CHALLENGE), "challenge_id", limit)
    return rows.select(F.col("challenge_id").alias("example_id"), F.lit("challenge").alias("split"), "semantic_case_id", "input", F.col("reference_report").alias("reference_text"), "difficulty_tags")


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Curated fixtures: the nested record's fields (left out: not_mentioned), dims or dims_state, and the report."""
    n = F.col("structure.nodules")[0]
    rows = _lines(spark, path, FIXTURE)
    get = lambda c: F.coalesce(c, F.lit("not_mentioned"))
    dims = n["dimensions_mm"]
    listed = F.from_json(F.when(dims.startswith("["), dims), "array<double>")
    fields = {f: get(n[f]) for f in ("composition", "echogenicity", "shape", "margin", "echogenic_foci", "vascularity")}
    fields |= {"location_side": get(n["location"]["side"]), "location_segment": get(n["location"]["segment"]), "lymph_nodes": get(F.col("structure.lymph_nodes"))}
    return rows.select(F.col("sample_id").alias("example_id"), F.lit("fixtures").alias("split"), *[v.alias(k) for k, v in fields.items()], listed.alias("dims"), F.when(listed.isNull(), get(dims)).alias("dims_state"), F.col("report").alias("reference_text"))


def telemetry(lines: DataFrame, column: str = "value") -> DataFrame:
    """Device rows "temperature, utilization, memory, power" with blanks around and [N/A] for a missing power."""
    parts = F.transform(F.split(column, ","), lambda x: F.trim(x))
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("double")
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, number(1).alias("temperature_c"), number(2).alias("utilization_percent"), number(3).alias("memory_used_mib"), number(4).alias("power_w"))


def poll_devices(spark: SparkSession, command: list[str], seconds: float = 5.0) -> DataFrame:
    """One reading of device rows from a command's lines, with its time; a command that fails or takes too long gives no rows, as telemetry must not stop a run."""
    try:
        done = subprocess.run(command, capture_output=True, text=True, timeout=seconds, check=True)
        lines = [line for line in done.stdout.splitlines() if line.strip()]
    except (OSError, subprocess.SubprocessError):
        lines = []
    return telemetry(spark.createDataFrame([(line,) for line in lines], "value string").withColumn("at", utc_stamp()))


def text_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row's texts as rows of their own (a sample's input and target, for a vocabulary): the other columns, role and text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).alias("text")) for c in columns])
    return df.withColumn("_pair", F.explode(pairs)).select(*[c for c in df.columns if c not in columns], "_pair.role", "_pair.text")


def with_first_of(base: DataFrame, more: DataFrame, keep: Column, order: str, limit: int) -> DataFrame:
    """A small table and, behind it, the first rows of another that are kept, in a stated order; columns by name."""
    return base.unionByName(first_rows(more.filter(keep), order, limit))


def per_group(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first rows of each group in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_n") <= limit).drop("_n")
