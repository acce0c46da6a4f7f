"""Sinks: releases in JSON lines and parquet, manifests, append-only event logs, Markdown."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.exprs import digest_rank, utc_stamp


def json_lines(df: DataFrame) -> DataFrame:
    """One column, value: each row as JSON with keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_release(df: DataFrame, path: str, part: str, order: str) -> None:
    """Parquet, one folder a part, rows in order; a release is made once: an existing path is an error."""
    df.repartition(part).sortWithinPartitions(part, order).write.mode("errorifexists").partitionBy(part).parquet(path)


def write_json_lines(df: DataFrame, path: str, order: str) -> None:
    """JSON lines in order in one file, for releases of a reviewed size; made once."""
    lines = df.select(order, F.to_json(F.struct(*sorted(df.columns))).alias("value"))
    lines.coalesce(1).sortWithinPartitions(order).select("value").write.mode("errorifexists").text(path)


def shared_folder(spark: SparkSession, kind: str = "table") -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one, gone when Python ends, only in local mode, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix=f"millrace-{kind}-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """A table that several branches of a query read: written once to the shared folder and read back."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def line_manifest(rows: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """keys, records, bytes, sha256 of files that hold each group's lines in order. A group is a file: it must be of a file's size."""
    text = F.concat(F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length(line) + 1).alias("bytes"), F.sha2(text, 256).alias("sha256"))


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path (relative), bytes and sha256 of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    relative = F.regexp_replace("path", rf"^.*{os.path.basename(path.rstrip('/'))}/", "")
    return files.select(relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, recorded: DataFrame, path: str, pattern: str = "*") -> DataFrame:
    """What differs from a recorded manifest: path, problem (missing, unexpected, changed)."""
    now = manifest(spark, path, pattern).select("path", F.col("sha256").alias("now"))
    both = recorded.select("path", F.col("sha256").alias("then")).join(now, "path", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "unexpected").when(F.col("now") != F.col("then"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem is not null")


def numbered_files(rows: DataFrame, part: str, digest: str, lines: int) -> DataFrame:
    """Adds file: each part's rows, in the order of a text that begins with a hex digest, so many to a file."""
    ranked = digest_rank(rows, digest, "_rank", [part])
    return ranked.withColumn("file", F.floor((F.col("_rank") - 1) / lines).cast("bigint")).drop("_rank")


def payload_sha256(record: Mapping) -> str:
    """Of a record's canonical JSON: keys in order, no blanks."""
    return hashlib.sha256(json.dumps(record, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def write_bundle(rows: DataFrame, part: str, order: str, statistics: DataFrame, folder: str, name: str, about: Mapping | None = None, lines: int = 1_000_000) -> dict:
    """A dataset release in one call: JSON lines in order for each part, in files of so many lines that tasks write, statistics.json (a long table's rows) and manifest.json, which lists every
    file with path, sha256, bytes and records. Made once: an existing folder is an error. Without its manifest, which comes last and at once, a folder is no release."""
    from millrace.sources import releases

    files, root = releases.located(folder)
    if files.get_file_info(root).type.name != "NotFound":
        raise FileExistsError(f"{folder} exists")
    releases.write_files(rows, part, order, folder, lines, {}, "lines.json")
    listed = releases.get_json(folder, "lines.json")["files"]
    found: dict[str, dict] = {e["path"].removesuffix(".jsonl"): e for e in listed}
    releases.put_json(folder, "statistics.json", [r.asDict() for r in statistics.orderBy(*statistics.columns).collect()])  # a report's size
    found["statistics"] = {"path": "statistics.json", "sha256": releases.file_sha256(folder, "statistics.json"), "bytes": files.get_file_info(f"{root}/statistics.json").size, "records": None}
    made = {"manifest_version": "1.0.0", "dataset_name": name, "files": found} | dict(about or {})
    releases.put_json(folder, "manifest.json", made)
    return made


def write_frozen(rows: DataFrame, order: str, path: str, record_path: str, about: Mapping, links: Mapping[str, str] | None = None) -> dict:
    """A challenge release, made once: a file of JSON lines in order, which one task writes as a stream, and a record that freezes it (hash, bytes, rows, what it rests on) with a hash of its own. An
    existing file is an error. links: name -> path of a file whose hash the record keeps. The path ends with .jsonl."""
    from millrace.sources import releases

    if os.path.exists(path) or os.path.exists(record_path):
        raise FileExistsError(f"{path} or {record_path} exists")
    folder, stem = os.path.dirname(os.path.abspath(path)), os.path.basename(path).removesuffix(".jsonl")
    listing = f".{stem}.{uuid.uuid4().hex}.json"
    part = "_part" if "_part" not in rows.columns else "_part_"
    releases.write_files(rows.withColumn(part, F.lit(stem)), part, order, folder, 1 << 62, {}, listing)
    found = releases.get_json(folder, listing)["files"]
    os.remove(os.path.join(folder, listing))
    if not found:  # no rows: an empty file
        open(path, "xb").close()
        found = [{"path": f"{stem}.jsonl", "sha256": hashlib.sha256(b"").hexdigest(), "bytes": 0, "records": 0}]
    record = {"freeze_version": "1.0.0", "status": "frozen", "created_at_utc": rows.sparkSession.range(1).select(utc_stamp()).first()[0], "file": found[0], "linked": {}, "about": dict(about)}
    for name, linked in (links or {}).items():
        record["linked"][name] = {"path": os.path.basename(linked), "sha256": releases.file_sha256(*os.path.split(os.path.abspath(linked)))}
    record["payload_sha256"] = payload_sha256(record)
    write_json(record, record_path)
    return record


def frozen_problems(path: str, record_path: str) -> list[str]:
    """What differs from a freeze record: its own payload, or the file that it froze."""
    with open(record_path, encoding="utf-8") as source:
        record = json.load(source)
    own = record.pop("payload_sha256", None)
    out = [] if own == payload_sha256(record) else ["record"]
    with open(path, "rb") as source:
        content = source.read()
    if hashlib.sha256(content).hexdigest() != record["file"]["sha256"] or len(content) != record["file"]["bytes"]:
        out.append("file")
    return out


def chain_problems(records: Mapping[str, Mapping[str, str]]) -> list[str]:
    """Names of links (data -> tokenizer -> freeze -> challenge) whose recorded hash isn't that of what they name.

    records: name -> {"sha256": own hash, "of:<other>": the other's hash as recorded here}.
    """
    out = []
    for name, fields in records.items():
        for key, value in fields.items():
            if key.startswith("of:") and records.get(key[3:], {}).get("sha256") != value:
                out.append(f"{name} -> {key[3:]}")
    return sorted(out)


def safe_relative(path: str) -> str:
    """A path below its root, or an error."""
    if not path or os.path.isabs(path) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"path leaves its root: {path!r}")
    return path


def write_json(payload: object, path: str) -> None:
    """Indented JSON with keys in order, replaced at once."""
    with open(path + ".new", "w", encoding="utf-8") as out:
        out.write(json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    os.replace(path + ".new", path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def shown(value: object) -> str:
    """Numbers to four digits, nulls as a dash."""
    return "–" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, title: str, order: Sequence[str]) -> str:
    """A table of collected aggregates; numbers to four digits, nulls as a dash."""
    rows = df.orderBy(*order).collect()
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(r[c]) for c in df.columns) + " |" for r in rows]) + "\n"


def report(title: str, about: Mapping[str, object], notes: Sequence[str], sections: Mapping[str, Mapping[str, object]]) -> str:
    """A Markdown report: what it is about as a list, notes, and a section of values for each split, which are never averaged together."""
    lines = [f"# {title}", "", *[f"- {k}: `{shown(v)}`" for k, v in about.items()], "", *notes]
    for name, values in sections.items():
        lines += ["", f"## {name}", "", *[f"- {k}: `{shown(v)}`" for k, v in values.items()]]
    return "\n".join(lines) + "\n"


def sections(df: DataFrame, by: str, names: Mapping[str, str]) -> dict[str, dict[str, object]]:
    """Report sections from a table of rates, one row to a group: group -> label -> value, with labels for columns."""
    return {r[by]: {label: r[column] for column, label in names.items()} for r in df.orderBy(by).collect()}


RATES = {"n": "Samples", "parseable_rate": "Parseable", "any_family_rate": "In a template family", "mentioned_accuracy": "Accuracy of mentioned fields", "hallucination_rate": "Hallucination rate", "dim_exact_rate": "Measurements exact", "dim_mean_error": "Measurements' mean error (mm)"}
CLEAN = {"n": "Samples", "pass_rate": "Pass rate", "mean_errors": "Mean errors", "mean_warnings": "Mean warnings", "false_errors": "False errors"}
DEFECT = {"expected_rule": "Rule", "support": "Support", "detected": "Detected", "recall": "Recall"}


def generate_report(rates: DataFrame, by: str, about: Mapping[str, object], losses: DataFrame | None = None) -> str:
    """Of generated reports: rates by split, and loss and accuracy under teacher forcing (by, loss, accuracy), where there are any."""
    found = sections(rates, by, RATES)
    for r in losses.collect() if losses is not None else ():  # a row for each split
        found.setdefault(r[by], {}).update({"Loss": r["loss"], "Token accuracy": r["accuracy"]})
    return report("Generated reports", about, ["Challenge splits are stated apart and never averaged with the template splits."], found)


def extract_report(rates: DataFrame, exact: DataFrame, by: str, about: Mapping[str, object]) -> str:
    """Of records extracted from reports: rates by split, and the share of records that are wholly right (by, exact_rate)."""
    found = sections(rates, by, RATES)
    for r in exact.collect():  # a row for each split
        found.setdefault(r[by], {})["Whole record exact"] = r["exact_rate"]
    return report("Extracted records", about, ["Rules alone, no trained model."], found)


def qc_report(clean: DataFrame, by: str, recall: DataFrame, about: Mapping[str, object]) -> str:
    """Of quality rules: clean pairs by split, then recall of each injected defect and over all."""
    found = sections(clean, by, CLEAN) | sections(recall, "defect_id", DEFECT)
    if first := recall.first():
        found["all defects"] = {"Micro recall": first["micro_recall"], "Macro recall": first["macro_recall"]}
    return report("Quality rules", about, ["An error on a clean pair is a false one."], found)
