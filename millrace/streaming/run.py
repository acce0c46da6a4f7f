"""Runs of streams over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.sinks import shared_folder


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream, with the schema that it has."""
    there = spark.read.parquet(path)
    reader = spark.readStream.schema(there.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    parent, _, name = path.rpartition("/")
    files = there.inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}"):  # a file: its folder is watched for this name
        return reader.option("pathGlobFilter", name).parquet(parent)
    return reader.parquet(path)


def available_rows(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, in append mode, to a parquet table, and reads that. Rows come once over restarts."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
