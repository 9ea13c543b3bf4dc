"""Batch entry: spark-submit vistrata/job.py analyze|report|info FILE [-o OUTPUT] [--tidy]"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from vistrata.sources import files, report

ANALYSIS = ("overview", "summary", "correlation")


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="vistrata")
    parser.add_argument("command", choices=("analyze", "report", "info"))
    parser.add_argument("file")
    parser.add_argument("-o", "--output")
    parser.add_argument(
        "--tidy", action="store_true", help="write tidy JSON lines with Spark instead of a document"
    )
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = _arguments(argv)
    local = "://" not in args.file
    if local and not os.path.exists(args.file):
        print(f"Error: file not found - {args.file}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("vistrata").getOrCreate()
    try:
        df = files.load(spark, args.file)
    except AnalysisException as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    if args.command == "info":
        for item, detail, value in report.dataset_info(df).collect():
            print(f"{item:<40} {detail or '':<15} {value:g}")
        return 0
    sections = ANALYSIS if args.command == "analyze" else report.SECTIONS
    output = args.output or ("report.json" if args.command == "report" else None)
    if args.tidy and output:
        report.write_report(df, output, sections)
    elif output:
        report.save_document(df, output, sections)
    else:
        print(json.dumps(report.report_document(df, sections), indent=2, default=str))
    if output:
        print(f"saved to {output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
