"""The extract job: validation before any job, NDJSON output, summary line."""

import glob
import gzip
import json
import os

from regsight.__main__ import main
from regsight.plans import reports as R
from regsight.session import scratch_path


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_extract_poms_gzip(spark, sf_small, capsys):
    out = scratch_path(spark, "cli-poms")
    code = main(["extract", "poms", "--sf-dir", sf_small, "--year", "2026", "--out", out, "--gzip"])
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert code == 0 and summary["status"] == "completed"
    lines = []
    for part in glob.glob(os.path.join(_local(out), "part-*.gz")):
        with gzip.open(part, "rt", encoding="utf-8") as fh:
            lines.extend(fh.read().splitlines())
    assert len(lines) == summary["records"] == R.paycal_poms(spark, sf_small, 2026).count()
    assert all(json.loads(x)["organisationId"] is not None for x in lines)


def test_extract_in_parts_again(spark, sf_small, capsys):
    out = scratch_path(spark, "cli-parts")
    for _ in range(2):
        assert main(["extract", "organisations", "--sf-dir", sf_small, "--year", "2026", "--out", out,
                     "--parts", "5"]) == 0
        summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert summary["records"] == R.paycal_organisations(spark, sf_small, 2026).count()
    assert spark.read.json(out).count() == summary["records"]


def test_extract_rejects_year_before_any_job(capsys):
    code = main(["extract", "organisations", "--sf-dir", "/nonexistent", "--year", "2024",
                 "--out", "/nonexistent/out"])
    assert code == 2 and json.loads(capsys.readouterr().out)["status"] == "rejected"
