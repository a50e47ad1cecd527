"""Batch jobs for the pay-calculation extracts (``python -m regsight`` or spark-submit).

    python -m regsight extract poms --sf-dir DIR --year 2026 --out PATH [--gzip]
    python -m regsight extract organisations --sf-dir DIR --year 2026 --out PATH --parts 200

With ``--parts`` the export keeps what its tasks committed: the same command goes on
where a failed run ended, and its summary counts the records so far. The relative year is validated before any Spark job starts (F6). The
extract is written as NDJSON part files (S4) and the export summary (S5:
records, seconds, status) is printed as one JSON line, also when the export
fails (then the exit status is 1).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from regsight.operators.filters import validate_relative_year
from regsight.plans import reports as R
from regsight.session import DEFAULT_CONF, ensure_checkpoint_dir
from regsight.sources import export as X
from regsight.sources import resumable as XR

EXTRACTS = {"poms": R.paycal_poms, "organisations": R.paycal_organisations}
#: The columns that deal an extract's rows to parts.
EXTRACT_KEYS = {"poms": ["organisation_id", "subsidiary_id", "submission_period", "packaging_class"],
                "organisations": ["organisation_id"]}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="regsight")
    sub = parser.add_subparsers(dest="command", required=True)
    ex = sub.add_parser("extract", help="write a pay-calculation extract as NDJSON")
    ex.add_argument("kind", choices=sorted(EXTRACTS))
    ex.add_argument("--sf-dir", required=True)
    ex.add_argument("--year", required=True, type=int)
    ex.add_argument("--out", required=True)
    ex.add_argument("--gzip", action="store_true")
    ex.add_argument("--max-records-per-file", type=int, default=None)
    ex.add_argument("--parts", type=int, default=None, help="write a resumable export of so many parts")
    args = parser.parse_args(argv)

    try:
        year = validate_relative_year(args.year)
    except ValueError as exc:
        print(json.dumps({"status": "rejected", "error": str(exc)}))
        return 2
    builder = SparkSession.builder.appName(f"regsight-extract-{args.kind}")
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    df = EXTRACTS[args.kind](spark, args.sf_dir, year)
    seen = []
    try:
        compression = "gzip" if args.gzip else None
        if args.parts:
            XR.export_resumable(df, args.out, EXTRACT_KEYS[args.kind], args.parts, compression, seen.append)
        else:
            X.export_with_summary(df, args.out, compression, on_complete=seen.append,
                                  max_records_per_file=args.max_records_per_file)
    except Exception:  # noqa: BLE001 - the summary below reports it
        if not seen:
            raise
    summary = seen[0]
    print(json.dumps({"status": summary.status, "records": summary.records,
                      "seconds": round(summary.seconds, 3), "path": summary.path,
                      **({"error": summary.error} if summary.error else {})}))
    return 0 if summary.status == "completed" else 1


if __name__ == "__main__":
    sys.exit(main())
