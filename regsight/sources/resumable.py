"""S5 with a count so far: an NDJSON export that keeps what its tasks committed.

The rows of an export are dealt to ``parts`` by a hash of their key, one task
and one part file each, so which rows a part holds follows from the rows alone.
Tasks commit on their own (output committer version 2: a task's file is moved
into place when the task ends, and a repeated attempt replaces it), so an
export that fails or is stopped keeps every part that ended.

Beside the part files lies a manifest (``_manifest``): per part its file, rows,
bytes and a digest of its lines, read back from the committed file. It gives
the count so far of an aborted export, tells a second run which parts are left, and
lets ``verify_export`` find a damaged or missing part. The next run first adds what
an interrupted one committed without recording.

The source has to hold the same rows in every run; ``_plan`` records the number of
parts, the keys and the columns, and a run with others is refused. ``_complete`` marks
an export that ended; another run of it starts no job. Names that begin with an underscore are
no data to Spark's readers. Spark writes an empty file for a first partition without
rows: such files stand for no part. The price is one shuffle of the rows.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regsight.sources.export import ExportSummary, camel_columns, stopped_by_caller

MANIFEST_SCHEMA = "part int, file string, rows bigint, bytes bigint, digest string"
PART_COLUMN = "_part"


@dataclass
class ResumableSummary(ExportSummary):
    """``records``: rows in committed parts, over all runs; ``written``: those of this run."""
    written: int = 0
    parts: int = 0


def _read(spark: SparkSession, path: str, reader) -> DataFrame | None:
    try:
        return reader(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per recorded part."""
    found = _read(spark, os.path.join(path, "_manifest"), spark.read.schema(MANIFEST_SCHEMA).parquet)
    return found if found is not None else spark.createDataFrame([], MANIFEST_SCHEMA)


def _part_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``path`` of the committed part files; contents are not read."""
    files = _read(spark, path, spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load)
    if files is None:
        return spark.createDataFrame([], "path string, file string")
    return files.select("path", F.substring_index("path", "/", -1).alias("file"))


def _described(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Manifest rows of part files, from their lines."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"))
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string").alias("digest")).select(
        F.regexp_extract("file", r"^part-(\d+)-", 1).cast("int").alias("part"), "file", "rows", "bytes", "digest")


def record_parts(spark: SparkSession, path: str) -> None:
    """Add the part files that the manifest does not know yet (at most one per part)."""
    known = manifest(spark, path).select("file")
    new = [r.path for r in _part_files(spark, path).join(known, "file", "left_anti").select("path").collect()]
    if new:
        _described(spark, new).coalesce(1).write.mode("append").parquet(os.path.join(path, "_manifest"))


def _check_plan(spark: SparkSession, path: str, plan: dict) -> None:
    """Record how the export is dealt, or refuse to go on with another."""
    at = os.path.join(path, "_plan")
    found = _read(spark, at, spark.read.text)
    text = json.dumps(plan, sort_keys=True)
    if found is None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    elif (stored := found.first()[0]) != text:
        raise ValueError(f"the export in {path} was begun as {stored}, not as {text}")


def _totals(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    rows = manifest(spark, path).select("part", "rows").collect()
    return sum(r["rows"] for r in rows), sorted(r["part"] for r in rows)


def export_resumable(df: DataFrame, path: str, key_cols: list[str], parts: int, compression: str | None = None,
                     on_complete=None, only_parts: range | None = None) -> ResumableSummary:
    """Write what is left of the export of ``df`` under ``path``.

    The summary is delivered once, also on failure, with the count so far; an
    error is raised again. ``only_parts`` leaves the other parts to a later
    run, and the status is then ``aborted`` until none is left.
    """
    spark = df.sparkSession
    start = time.monotonic()
    _check_plan(spark, path, {"parts": int(parts), "keys": list(key_cols), "columns": df.columns,
                              "compression": compression})
    record_parts(spark, path)
    before, done = _totals(spark, path)

    def summary(status, error=None):
        records, own = _totals(spark, path)
        return ResumableSummary(records, time.monotonic() - start, status, path, error, records - before, len(own))

    ended = os.path.join(path, "_complete")
    if _read(spark, ended, spark.read.text) is not None:
        out = summary("completed")
        if on_complete is not None:
            on_complete(out)
        return out
    part = F.pmod(F.xxhash64(*key_cols), F.lit(parts)).cast("int")
    rows = df.withColumn(PART_COLUMN, part)
    if done:
        rows = rows.filter(~F.col(PART_COLUMN).isin(done))
    if only_parts is not None:
        rows = rows.filter(F.col(PART_COLUMN).between(only_parts.start, only_parts.stop - 1))
    writer = (rows.repartitionById(parts, PART_COLUMN).select(*camel_columns(df)).write.mode("append")
              .option("encoding", "UTF-8").option("lineSep", "\n")
              .option("mapreduce.fileoutputcommitter.algorithm.version", "2"))
    if compression:
        writer = writer.option("compression", compression)
    try:
        writer.json(path)
    except BaseException as exc:
        record_parts(spark, path)
        out = summary("aborted" if stopped_by_caller(exc) else "failed", str(exc))
        if on_complete is not None:
            on_complete(out)
        raise
    record_parts(spark, path)
    whole = only_parts is None or (only_parts.start <= 0 and only_parts.stop >= parts)
    if whole:
        spark.createDataFrame([(str(summary("completed").records),)], "value string").coalesce(1).write.text(ended)
    out = summary("completed" if whole else "aborted")
    if on_complete is not None:
        on_complete(out)
    return out


def verify_export(spark: SparkSession, path: str) -> DataFrame:
    """Parts whose file is gone or is not what the manifest says (``part``, ``problem``)."""
    known = manifest(spark, path)
    files = [r.path for r in _part_files(spark, path).select("path").collect()]
    now = _described(spark, files) if files else spark.createDataFrame([], MANIFEST_SCHEMA)
    now = now.select("file", F.struct("rows", "bytes", "digest").alias("now"))
    both = known.join(now, "file", "full")
    problem = (F.when(F.col("now").isNull(), F.lit("missing")).when(F.col("part").isNull(), F.lit("not recorded"))
               .when(F.struct("rows", "bytes", "digest") != F.col("now"), F.lit("changed")))
    return both.select("part", "file", problem.alias("problem")).filter("problem is not null")
