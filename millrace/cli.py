"""python -m millrace.cli info | extract REPORT | qc REPORT [--record JSON] | generate --record JSON. "-" reads standard input, "@file" a file."""

from __future__ import annotations

import argparse
import json
import sys


def read(argument: str) -> str:
    if argument == "-":
        return sys.stdin.read()
    if argument.startswith("@"):
        with open(argument[1:], encoding="utf-8") as source:
            return source.read()
    return argument


def main(arguments: list[str] | None = None, spark=None) -> dict:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("info")
    for name in ("extract", "qc"):
        commands.add_parser(name).add_argument("report")
    commands.choices["qc"].add_argument("--record")
    commands.add_parser("generate").add_argument("--record", required=True)
    asked = parser.parse_args(arguments)
    from millrace.operators import service

    if asked.command == "info":
        out = service.info()
    else:
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F

        from millrace.operators.render import fragments, report
        from millrace.sources.cases import parse_json

        spark = spark or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        record = read(asked.record) if getattr(asked, "record", None) else None
        rows = spark.createDataFrame([(read(asked.report) if asked.command != "generate" else "", record)], "report string, input string")
        if asked.command == "extract":
            result = service.extract(rows.select("report"))
        elif asked.command == "qc":
            result = service.check(parse_json(rows) if record else rows, with_record=bool(record)).select("findings", "error_count", "warning_count", "passed")
        else:
            result = fragments(parse_json(rows)).select(report("location_first_v2").alias("report"))
        out = json.loads(result.select(F.to_json(F.struct("*")).alias("j")).first()["j"])
    print(json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True))
    return out


if __name__ == "__main__":
    main()
