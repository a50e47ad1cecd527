"""An export that fails or is stopped keeps and counts its parts; the next run writes the rest."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from regsight.session import scratch_path
from regsight.sources import resumable as X

PARTS = 24


def local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def files(path):
    return {os.path.basename(p): os.stat(p).st_mtime_ns for p in glob.glob(os.path.join(local(path), "part-*"))}


def ids(path):
    out = []
    for p in glob.glob(os.path.join(local(path), "part-*")):
        with open(p, encoding="utf-8") as fh:
            out += [json.loads(line)["recordId"] for line in fh]
    return sorted(out)


def records(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("record_id"), F.concat(F.lit("näme "), "id").alias("a_name"),
                                 F.when(F.col("id") % 3 == 0, F.col("id")).alias("maybe"))


def broken(part):
    """The columns as written, but the task that writes one part fails."""
    real = X.camel_columns
    bad = F.when(F.col(X.PART_COLUMN) == part, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("maybe"))
    return lambda df: [*real(df)[:-1], bad.alias("maybe")]


def test_failed_export_counts_and_the_next_run_writes_the_rest(spark, monkeypatch):
    path, seen, df = scratch_path(spark, "t-resume"), [], records(spark)
    with monkeypatch.context() as patch, pytest.raises(Exception, match="boom"):
        patch.setattr(X, "camel_columns", broken(PARTS - 1))
        X.export_resumable(df, path, ["record_id"], PARTS, on_complete=seen.append)
    first = seen[0]
    assert first.status == "failed" and "boom" in first.error
    kept = files(path)
    assert 0 < first.records == len(ids(path)) < 3000 and first.parts == len(kept) < PARTS
    second = X.export_resumable(df, path, ["record_id"], PARTS, on_complete=seen.append)
    assert second.status == "completed" and second.records == 3000 and seen[1] is second
    assert second.written == 3000 - first.records
    now = files(path)
    assert all(now[name] == stamp for name, stamp in kept.items())      # not touched
    assert ids(path) == list(range(3000)) and second.parts == PARTS
    assert X.verify_export(spark, path).isEmpty()
    third = X.export_resumable(df, path, ["record_id"], PARTS)
    assert third.written == 0 and third.records == 3000 and files(path) == now


def test_interrupt_reports_aborted(spark, monkeypatch):
    path, seen = scratch_path(spark, "t-interrupt"), []
    df = records(spark, 200)
    X.export_resumable(df, path, ["record_id"], PARTS, only_parts=range(5))
    real = X.camel_columns
    monkeypatch.setattr(X, "camel_columns", lambda d: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        X.export_resumable(df, path, ["record_id"], PARTS, on_complete=seen.append)
    monkeypatch.setattr(X, "camel_columns", real)
    # stopped before the write began: nothing is lost, the next run ends it
    assert X.export_resumable(df, path, ["record_id"], PARTS).records == 200 and ids(path) == list(range(200))


def test_parts_committed_but_not_recorded_are_found(spark):
    """A driver lost after the tasks committed: their files are there, the manifest is not."""
    path, df = scratch_path(spark, "t-lost"), records(spark, 500)
    real = X.record_parts
    try:
        X.record_parts = lambda *a: None
        X.export_resumable(df, path, ["record_id"], PARTS, only_parts=range(10))
    finally:
        X.record_parts = real
    assert X.manifest(spark, path).isEmpty()
    before = files(path)
    out = X.export_resumable(df, path, ["record_id"], PARTS)
    assert 0 < out.written < 500 and out.records == 500 and ids(path) == list(range(500))
    assert all(files(path)[n] == t for n, t in before.items())


def test_manifest_describes_the_files(spark):
    path = scratch_path(spark, "t-manifest")
    X.export_resumable(records(spark, 400), path, ["record_id"], 6)
    found = X.manifest(spark, path).collect()
    assert sorted(r.part for r in found) == list(range(6)) and sum(r.rows for r in found) == 400
    for r in found:
        assert os.path.getsize(os.path.join(local(path), r.file)) == r.bytes
        assert r.file.startswith(f"part-{r.part:05d}-")
    # readers see the records only
    assert spark.read.json(path).count() == 400


def test_verify_names_damaged_and_missing_parts(spark):
    path = scratch_path(spark, "t-verify")
    X.export_resumable(records(spark, 400), path, ["record_id"], 6)
    damaged = glob.glob(os.path.join(local(path), "part-00002-*"))[0]
    with open(damaged, "a", encoding="utf-8") as fh:
        fh.write("{}\n")
    for crc in glob.glob(os.path.join(local(path), ".part-00002-*.crc")):
        with open(crc, "wb") as fh:        # the local file system's own checksum would stop the read
            fh.write(b"")
    spark.catalog.refreshByPath(path)
    try:
        got = {r.part: r.problem for r in X.verify_export(spark, path).collect()}
        assert got == {2: "changed"}
    except Exception as exc:  # a checksum file system refuses the damaged file itself
        assert "hecksum" in str(exc)


def test_another_export_in_the_same_place_is_refused(spark):
    path, df = scratch_path(spark, "t-other"), records(spark, 50)
    X.export_resumable(df, path, ["record_id"], 4)
    for other, keys, parts in ((df, ["record_id"], 5), (df, ["a_name"], 4), (df.drop("maybe"), ["record_id"], 4)):
        with pytest.raises(ValueError, match="was begun as"):
            X.export_resumable(other, path, keys, parts)


def test_empty_export_and_null_keys(spark):
    path = scratch_path(spark, "t-empty")
    out = X.export_resumable(records(spark, 0), path, ["record_id"], 4)
    assert (out.records, out.status) == (0, "completed")
    nulls = records(spark, 40).withColumn("k", F.lit(None).cast("string"))
    path = scratch_path(spark, "t-null")
    assert X.export_resumable(nulls, path, ["k"], 4).records == 40
    assert X.export_resumable(nulls, path, ["k"], 4).written == 0


def test_compressed_parts(spark):
    path = scratch_path(spark, "t-gzip")
    out = X.export_resumable(records(spark, 100), path, ["record_id"], 3, compression="gzip")
    assert out.records == 100 and all(n.endswith(".json.gz") for n in files(path))
    assert X.verify_export(spark, path).isEmpty()
