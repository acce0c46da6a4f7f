"""Releases written by tasks: a data source whose writers return what they wrote, and one commit that makes it a release.

Rows are ranked within their part in a stated order, whatever partitions they lie in, and cut into files of so many lines. Each file is written by one task, as a stream: to a name of that attempt's own, hashed
on the way, then renamed into place. A task answers with path, bytes, records and hash of its files; when all have, the driver writes the manifest to a new name and renames it. So a task that is lost leaves
nothing that a manifest lists, one that runs again writes the same bytes to the same place, and a release without its manifest is none. The driver holds one entry for each file.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from millrace.sources.sinks import materialized, payload_sha256, safe_relative

FORMAT = "release_files"
SCHEMA = "path string, line string"
ENTRIES = "path string, records bigint, bytes bigint, sha256 string"


def located(folder: str) -> tuple[fs.FileSystem, str]:
    """A folder's file system and path in it; a plain path is this machine's."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def replaced(files: fs.FileSystem, source: str, target: str) -> None:
    if files.get_file_info(target).type != fs.FileType.NotFound and not isinstance(files, fs.LocalFileSystem):
        files.delete_file(target)  # renames don't replace everywhere
    files.move(source, target)


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: entries of the manifest."""

    entries: list[dict]


class FileWriter(DataSourceArrowWriter):
    """Lines to files, as they come: rows of one path lie side by side in one task."""

    def __init__(self, options: Mapping[str, str]):
        self.folder, self.manifest, self.about = options["path"], options["manifest"], json.loads(options["about"])
        files, root = located(self.folder)
        if files.get_file_info(posixpath.join(root, self.manifest)).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.folder}/{self.manifest} exists: a release is made once")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = located(self.folder)
        entries, out, digest, new = [], None, None, ""

        def finish() -> None:
            out.close()
            replaced(files, new, posixpath.join(root, entries[-1]["path"]))
            entries[-1]["sha256"] = digest.hexdigest()

        try:
            for batch in iterator:
                paths, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                low = 0
                while low < len(paths):
                    high = low + 1
                    while high < len(paths) and paths[high] == paths[low]:
                        high += 1
                    if not entries or entries[-1]["path"] != paths[low]:
                        if out is not None:
                            finish()
                        entries.append({"path": safe_relative(paths[low]), "records": 0, "bytes": 0})
                        target = posixpath.join(root, paths[low])
                        files.create_dir(posixpath.dirname(target), recursive=True)
                        new = f"{posixpath.dirname(target)}/.{posixpath.basename(target)}.{uuid.uuid4().hex}"
                        out, digest = files.open_output_stream(new), hashlib.sha256()
                    data = "".join(f"{line}\n" for line in lines[low:high]).encode()
                    out.write(data)
                    digest.update(data)
                    entries[-1]["records"] += high - low
                    entries[-1]["bytes"] += len(data)
                    low = high
            if out is not None:
                finish()
                out = None
        finally:
            if out is not None and not out.closed:  # the attempt failed: what it had begun goes
                out.close()
                if files.get_file_info(new).type != fs.FileType.NotFound:
                    files.delete_file(new)
        return Written(entries)

    def commit(self, messages: list[Written | None]) -> None:
        entries = sorted((e for m in messages if m is not None for e in m.entries), key=lambda e: e["path"])
        if len({e["path"] for e in entries}) != len(entries):
            raise ValueError("two tasks wrote one file")
        put_json(self.folder, self.manifest, {"files": entries} | self.about)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = located(self.folder)
        for e in (e for m in messages if m is not None for e in m.entries):
            if files.get_file_info(posixpath.join(root, e["path"])).type != fs.FileType.NotFound:
                files.delete_file(posixpath.join(root, e["path"]))


def put_json(folder: str, name: str, payload: object) -> None:
    """Indented JSON with keys in order, in place at once."""
    files, root = located(folder)
    files.create_dir(root, recursive=True)
    new = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
    with files.open_output_stream(new) as out:
        out.write((json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())
    replaced(files, new, posixpath.join(root, name))


def get_json(folder: str, name: str) -> dict:
    files, root = located(folder)
    with files.open_input_stream(posixpath.join(root, name)) as source:
        return json.loads(source.read())


class ReleaseFiles(DataSource):
    """Format release_files, to write only. Options: path (a folder), manifest (a file name in it), about (JSON that the manifest holds besides)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options)


def ranked(df: DataFrame, part: str, order: list[str], name: str, total: str) -> DataFrame:
    """Numbers the rows of each part from 1 in an order, and adds their number in it: a sort by ranges, and prefix sums over the ranges' counts.

    A range holds one stretch of the sort, so a part's rows lie in neighbouring ranges, a hot part in many. The counts are at most one row for each range and part that meet:
    as many as ranges and parts together. Rows that the order doesn't tell apart must be alike for numbers to be the same again.
    """
    # the id of a row in a sorted partition is the partition's number and the row's place
    ranges = df.repartitionByRange(part, *order).sortWithinPartitions(part, *order)
    held = materialized(ranges.withColumn("_id", F.monotonically_increasing_id()))
    held = held.withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    from pyspark.sql import Window

    cells = held.groupBy(part, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(part)
    cells = cells.select(F.col(part).alias("_part"), F.col("_range").alias("_at"), (F.sum("_n").over(along.orderBy("_range")) - F.col("_n") - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(along).alias(total))
    joined = held.join(F.broadcast(cells), (F.col(part).eqNullSafe(F.col("_part"))) & (F.col("_range") == F.col("_at")))
    return joined.withColumn(name, F.col("_place") + F.col("_shift")).drop("_id", "_range", "_place", "_part", "_at", "_shift")


def write_files(rows: DataFrame, part: str, order: str, folder: str, lines: int, about: Mapping, manifest: str = "manifest.json") -> None:
    """JSON lines in order, files of so many lines below a folder, `<part>.jsonl` for a part of one file and `<part>-<number>.jsonl` otherwise, and the manifest that makes them a release."""
    spark = rows.sparkSession
    spark.dataSource.register(ReleaseFiles)
    columns = sorted(c for c in rows.columns if c != part)
    told = rows.select(F.col(part).cast("string").alias("part"), F.col(order).alias("order"), F.to_json(F.struct(*columns)).alias("line"))
    told = ranked(told, "part", ["order", "line"], "rank", "total")
    number = F.floor((F.col("rank") - 1) / lines).cast("string")
    stem = F.coalesce("part", F.lit("null"))
    path = F.when(F.col("total") <= lines, F.concat(stem, F.lit(".jsonl"))).otherwise(F.concat(stem, F.lit("-"), F.lpad(number, 6, "0"), F.lit(".jsonl")))
    dealt = told.withColumn("path", path).repartition("path").sortWithinPartitions("path", "rank").select("path", "line")
    dealt.write.format(FORMAT).mode("append").option("manifest", manifest).option("about", json.dumps(dict(about))).save(folder)


def manifest_rows(spark: SparkSession, folder: str, manifest: str = "manifest.json") -> DataFrame:
    """A manifest's entries as rows."""
    schema = f"files array<struct<{ENTRIES.replace(' ', ': ').replace(',:', ',')}>>"
    return spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{manifest}").select(F.explode("files").alias("f")).select("f.*")


def freeze(spark: SparkSession, folder: str, record: str, about: Mapping, links: Mapping[str, str] | None = None, manifest: str = "manifest.json") -> dict:
    """Freezes a release: a record beside its manifest, made once, that keeps the manifest's hash, what it is about, the hashes of the files that it rests on, and a hash of its own."""
    files, root = located(folder)
    if files.get_file_info(posixpath.join(root, record)).type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder}/{record} exists: a release is frozen once")
    total = manifest_rows(spark, folder, manifest).agg(F.count(F.lit(1)).alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    made = {"freeze_version": "1.0.0", "status": "frozen", "manifest": {"path": manifest, "sha256": file_sha256(folder, manifest)}, "about": dict(about)}
    made |= {k: total[k] or 0 for k in ("files", "records", "bytes")}
    made["linked"] = {name: {"path": path, "sha256": file_sha256(*posixpath.split(path))} for name, path in (links or {}).items()}
    made["payload_sha256"] = payload_sha256(made)
    put_json(folder, record, made)
    return made


def file_sha256(folder: str, name: str) -> str:
    files, root = located(folder)
    digest = hashlib.sha256()
    with files.open_input_stream(posixpath.join(root, name)) as source:
        while block := source.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def release_problems(spark: SparkSession, folder: str, record: str | None = None, manifest: str = "manifest.json") -> DataFrame:
    """path and problem (missing, unexpected, changed, unsafe) of all that differs from a release's manifest and its freeze record; no rows for a whole release. Files are hashed where they are read."""
    listed = manifest_rows(spark, folder, manifest)
    unsafe = F.col("path").startswith("/") | F.array_contains(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), "..")
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(folder)
    root = located(folder)[1].rstrip("/")
    relative = F.substring_index("path", f"{root}/", -1)
    now = base.select(relative.alias("at"), F.sha2("content", 256).alias("now"), "length")
    both = listed.join(now, F.col("path") == F.col("at"), "full")
    problem = F.when(unsafe, "unsafe").when(F.col("now").isNull(), "missing").when(F.col("path").isNull(), "unexpected").when((F.col("now") != F.col("sha256")) | (F.col("length") != F.col("bytes")), "changed")
    found = both.select(F.coalesce("path", "at").alias("path"), problem.alias("problem")).filter("problem is not null")
    own = []
    if record is not None:
        kept = get_json(folder, record)
        payload = kept.pop("payload_sha256", None)
        own += [(record, "changed")] if payload != payload_sha256(kept) else []
        own += [(manifest, "changed")] if kept["manifest"]["sha256"] != file_sha256(folder, manifest) else []
        own += [(x["path"], "changed") for x in kept["linked"].values() if file_sha256(*posixpath.split(x["path"])) != x["sha256"]]
    return found.unionByName(spark.createDataFrame(own, "path string, problem string"))
