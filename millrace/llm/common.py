"""Helpers shared by the operators: shared folder, written tables, Arrow plumbing."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one step of vectorised work, in bytes; bounds a worker's memory whatever the batch holds.
CHUNK_BYTES = 1 << 20


class _Made(threading.local):
    """Folders that shared_folder() gave to a thread: what another thread works with is never deleted from here."""

    def __init__(self) -> None:
        self.folders: list[str] = []


_MADE = _Made()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one, but on this machine's own
    executors only (local mode, as in tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base}/millrace-{uuid.uuid4().hex}"
    _MADE.folders.append(folder)
    return folder


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders that shared_folder() gave, once nothing reads them any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _MADE.folders:
            _MADE.folders.remove(folder)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM look for what is no longer in use: Spark then deletes the shuffle files of finished steps, which else lie on the executors'
    disks until the driver's memory happens to run short."""
    spark._jvm.System.gc()


def made() -> list[str]:
    """The folders that shared_folder() gave to this thread and that are still there."""
    return list(_MADE.folders)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cuts the lineage: writes a table in the shared folder and reads it back, so lost executors cost no recomputation of what is before."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.option("compression", "zstd").mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (long) and text, null text as empty; other columns, but for those to carry, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the first of it with underscores behind that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_file_scan(df: DataFrame) -> bool:
    """Whether each row of df is one row of one folder's files: a scan under projections and filters alone, so that file and row number tell rows apart."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias", "View"):
        node = node.children().head()
    if node.getClass().getSimpleName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return node.relation().location().rootPaths().size() == 1 and node.relation().fileFormat().toString() == "Parquet"


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with one more column, a struct (file, row) that is each row's own, and that column's name, which no other column has. Tables that
    aren't a plain scan of one folder's Parquet files (joins, unions, exploded rows) are written first."""
    if not is_file_scan(docs):
        docs = written(docs)
    name = free_name(docs, "_place")
    meta = docs.metadataColumn("_metadata")
    return docs.select("*", F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias(name)), name


def identity(place: str) -> list[Column]:
    """Two longs for the struct that located() adds: a hash of the file's path, and the row's number in it. Only files whose paths' 64-bit hashes are
    equal would be mixed up (3e-8 for a million files)."""
    return [F.xxhash64(F.col(place)["file"]).alias("file"), F.col(place)["row"].alias("row")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about limit bytes of text each; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column).cast(pa.binary())).to_pylist()
    low = total = 0
    for k, size in enumerate(sizes):
        if k > low and total + size > limit:
            yield batch.slice(low, k - low)
            low, total = k, 0
        total += size
    yield batch.slice(low)


def per_chunk(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text", carry: tuple[str, ...] = (), limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded size; work returns the output's columns by name. carry: columns of df to hand through, where
    work returns a row for each of its own."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    full = _parse_datatype_string(schema)
    for name in carry:
        full = full.add(df.schema[name])
    arrow = to_arrow_schema(full)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, column, limit):
                out = work(part) | {name: part.column(name) for name in carry}
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) and out[f.name].type == f.type else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, full)


#: A key is hot with more rows than this and than a HOT_SHARE-th of all rows: HOT_SHARE keys at most.
HOT_ROWS, HOT_SHARE = 1000, 10_000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], n: str, salt: list[str], how: str = "left") -> DataFrame:
    """The rows with a table's other columns, by keys that the table has once and n of the rows share. Rows of hot keys find theirs by broadcast (HOT_SHARE keys at most) and are spread by the salt's columns
    in the join of the others, so that no key's rows meet in a task. The table is read three times: it should be a written one. Null keys find nothing."""
    bound = max(HOT_ROWS, (table.agg(F.sum(n).alias("n")).first()["n"] or 0) // HOT_SHARE)
    values = [c for c in table.columns if c not in keys]
    hot = table.filter(F.col(n) > bound).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_is_hot"))
    same = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    marked = rows.join(F.broadcast(hot), reduce(Column.__and__, same), "left")
    marked = marked.withColumn("_salt", F.when(F.col("_is_hot"), F.xxhash64(*salt).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    nought = F.least(F.col(n).cast("long"), F.lit(0).cast("long"))  # not a literal: the optimizer would take that out of the join's keys
    joined = marked.join(table.withColumns({"_salt": nought, "_is_cold": F.lit(True)}).hint("merge"), [*keys, "_salt"], "left")
    if how == "inner":
        joined = joined.filter(F.coalesce("_is_hot", "_is_cold"))
    found = {c: F.when(F.col("_is_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)) for c in values}
    return joined.select(*rows.columns, *[v.alias(c) for c, v in found.items()])


def spread(*columns: str, parts: int) -> Column:
    """A salt from 0 to parts-1, decided by the columns' values alone, so that a task run again gives the same rows."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts))
