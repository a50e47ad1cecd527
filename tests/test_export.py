"""S4 NDJSON export and S5 summary."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from regsight.session import scratch_path
from regsight.sources import export as X


def _read_lines(path):
    out = []
    local = path[len("file:"):] if path.startswith("file:") else path
    for part in sorted(glob.glob(os.path.join(local, "part-*"))):
        with open(part, "rb") as fh:
            data = fh.read()
        assert not data.startswith(b"\xef\xbb\xbf")
        if data:
            assert data.endswith(b"\n")
        out.extend(data.decode("utf-8").splitlines())
    return out


def test_camel_case():
    assert X.camel_case("organisation_id") == "organisationId"
    assert X.camel_case("RecordId") == "recordId"
    assert X.camel_case("id") == "id"


def test_ndjson_lines_golden(spark):
    df = spark.createDataFrame([(1, "First"), (2, "Second"), (3, None)], "id int, name string")
    got = sorted(r.line for r in X.ndjson_lines(df).collect())
    assert got == ['{"id":1,"name":"First"}', '{"id":2,"name":"Second"}', '{"id":3}']


def test_ndjson_export_files(spark):
    df = spark.createDataFrame([(1, "First"), (2, None)], "record_id int, name string").coalesce(1)
    path = scratch_path(spark, "test-export")
    X.ndjson_export(df, path)
    assert sorted(_read_lines(path)) == ['{"recordId":1,"name":"First"}', '{"recordId":2}']


@pytest.mark.parametrize("n", [0, 1, 3])
def test_export_summary_counts(spark, n):
    seen = []
    df = spark.range(n).withColumnRenamed("id", "record_id")
    summary = X.export_with_summary(df, scratch_path(spark, "test-summary"), on_complete=seen.append)
    assert summary.records == n and summary.status == "completed" and seen == [summary]


def test_export_summary_failure_reported_then_raised(spark):
    seen = []
    df = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("boom")))
                               .otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        X.export_with_summary(df, scratch_path(spark, "test-fail"), on_complete=seen.append)
    assert len(seen) == 1 and seen[0].status == "failed" and seen[0].records is None


def test_max_records_per_file(spark):
    df = spark.range(10).withColumnRenamed("id", "record_id").coalesce(1)
    path = scratch_path(spark, "test-maxrec")
    X.ndjson_export(df, path, max_records_per_file=3)
    local = path[len("file:"):] if path.startswith("file:") else path
    parts = glob.glob(os.path.join(local, "part-*"))
    assert len(parts) == 4 and len(_read_lines(path)) == 10


def test_export_summary_interrupt_is_an_abort(spark, monkeypatch):
    def interrupted(*args, **kwargs):
        raise KeyboardInterrupt

    seen = []
    monkeypatch.setattr(X, "ndjson_export", interrupted)
    with pytest.raises(KeyboardInterrupt):
        X.export_with_summary(spark.range(3), scratch_path(spark, "test-abort"), on_complete=seen.append)
    assert [(s.status, s.records) for s in seen] == [("aborted", None)]


def test_export_summary_keeps_the_whole_error(spark, monkeypatch):
    def failing(*args, **kwargs):
        raise RuntimeError("x" * 2_000)

    seen = []
    monkeypatch.setattr(X, "ndjson_export", failing)
    with pytest.raises(RuntimeError):
        X.export_with_summary(spark.range(3), scratch_path(spark, "test-error"), on_complete=seen.append)
    assert len(seen[0].error) == 2_000 and seen[0].status == "failed"
