"""Newline-delimited JSON export (S4) and its summary.

Executors write part files in parallel; Spark's JSON writer emits one object
per line, UTF-8 without a byte-order mark, and leaves out null fields. The
record count comes from an ``Observation`` filled by the same job that
writes, so the data is read once.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def camel_case(name: str) -> str:
    """``organisation_id`` -> ``organisationId``; ``RecordId`` -> ``recordId``."""
    if "_" not in name:
        return name[:1].lower() + name[1:]
    head, *rest = [p for p in name.split("_") if p]
    return head.lower() + "".join(p[:1].upper() + p[1:] for p in rest)


def camel_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`").alias(camel_case(c)) for c in df.columns]


# S4 ------------------------------------------------------------------------
def ndjson_lines(df: DataFrame, out: str = "line") -> DataFrame:
    """The export as text: one JSON object per row, camelCase names, nulls omitted."""
    return df.select(F.to_json(F.struct(*camel_columns(df))).alias(out))


def ndjson_export(df: DataFrame, path: str, compression: str | None = None,
                  mode: str = "errorifexists", max_records_per_file: int | None = None) -> None:
    """Write ``df`` as NDJSON part files under ``path`` (optionally gzip).

    ``max_records_per_file`` caps the size of each part file (each task
    starts a new file when it is reached); no row is dropped.
    """
    writer = df.select(*camel_columns(df)).write.mode(mode).option("encoding", "UTF-8") \
        .option("lineSep", "\n")
    if compression:
        writer = writer.option("compression", compression)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", int(max_records_per_file))
    writer.json(path)


# S5 ------------------------------------------------------------------------
def stopped_by_caller(exc: BaseException) -> bool:
    """An interrupt or a cancelled job, not an error of the export."""
    return not isinstance(exc, Exception) or "SPARK_JOB_CANCELLED" in str(exc)


@dataclass
class ExportSummary:
    records: int | None
    seconds: float
    status: str  # "completed", "failed" or "aborted"
    path: str
    error: str | None = None


def export_with_summary(df: DataFrame, path: str, compression: str | None = None,
                        on_complete=None, max_records_per_file: int | None = None) -> ExportSummary:
    """S4 plus a summary delivered once at the end, also on failure.

    An interrupt or a cancelled job reports status ``aborted``, any other
    error ``failed``; both are raised again. Spark commits no output then;
    ``resumable.export_resumable`` keeps and counts what was written so far.
    """
    obs = Observation()
    observed = df.observe(obs, F.count(F.lit(1)).alias("records"))
    start = time.monotonic()
    summary: ExportSummary
    try:
        ndjson_export(observed, path, compression, max_records_per_file=max_records_per_file)
        summary = ExportSummary(int(obs.get["records"]), time.monotonic() - start, "completed", path)
    except BaseException as exc:  # reported, then raised again
        status = "aborted" if stopped_by_caller(exc) else "failed"
        summary = ExportSummary(None, time.monotonic() - start, status, path, str(exc))
        if on_complete is not None:
            on_complete(summary)
        raise
    if on_complete is not None:
        on_complete(summary)
    return summary
