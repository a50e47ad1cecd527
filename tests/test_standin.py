"""Scan hints of the stand-in views are supersets of the exact predicates."""

import pytest
from pyspark.sql import functions as F

from regsight.operators import filters as FL
from regsight.sources import standin as V

SF = "/root/testdata/sf0.01"


def _ids(df):
    return sorted(r.submission_id for r in df.select("submission_id").collect())


@pytest.mark.parametrize("lo,hi", [("2025-02-28 00:00:00", "2025-03-01 00:00:00"),
                                   ("2029-02-28 00:00:00", None), (None, "2025-02-28 23:59:59"),
                                   ("2024-12-31 00:00:00", "2025-01-01 00:00:00")])
def test_submitted_between_hint_is_exact_after_filter(spark, lo, hi):
    def exact(df):
        if lo is not None:
            df = df.filter(F.col("submitted_at") >= FL.ts_ntz(lo))
        if hi is not None:
            df = df.filter(F.col("submitted_at") <= FL.ts_ntz(hi))
        return df
    hinted = exact(V.submissions(spark, SF, submitted_between=(lo, hi)))
    plain = exact(V.submissions(spark, SF))
    assert _ids(hinted) == _ids(plain)


@pytest.mark.parametrize("statuses", [["Accepted"], ["Pending", "Rejected"], ["Rejected"]])
def test_status_hint(spark, statuses):
    hinted = V.submissions(spark, SF, statuses=statuses)
    plain = V.submissions(spark, SF).filter(F.col("status").isin(statuses))
    assert _ids(hinted) == _ids(plain)


def test_year_and_kind_hints(spark):
    hinted = V.submissions(spark, SF, years=[2025, 2027], kind="Registration")
    plain = V.submissions(spark, SF).filter(F.col("submission_year").isin(2025, 2027)
                                            & (F.col("submission_type") == "Registration"))
    assert _ids(hinted) == _ids(plain)


def test_size_hint(spark):
    hinted = V.organisations(spark, SF, size="L")
    plain = V.organisations(spark, SF).filter(F.col("organisation_size") == "L")
    assert sorted(r.organisation_id for r in hinted.collect()) == \
        sorted(r.organisation_id for r in plain.collect())


def test_hints_reach_the_scan(spark):
    df = V.submissions(spark, SF, years=[2025], kind="Producer", statuses=["Accepted"],
                       submitted_between=("2025-03-01 00:00:00", None))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    scan_filter = next(line for line in plan.splitlines() if "Filter" in line and "o_orderdate" in line)
    # every hint is a predicate on a raw column right above the parquet scan
    for needle in ("o_orderdate#", ">= 1996-01-01", "< 1997-01-01", ">= 1996-02-28",
                   "o_orderstatus#", "= F)", "NOT o_orderpriority#"):
        assert needle in scan_filter, needle
    assert "PushedFilters: [IsNotNull(o_orderdate), IsNotNull(o_orderstatus), GreaterThanOrEqual" in plan


def test_event_hints(spark):
    plain = V.submission_events(spark, SF)
    decided = V.submission_events(spark, SF, decided_only=True)
    assert decided.count() == plain.filter(F.col("decision").isNotNull()).count()
    with_ref = V.submission_events(spark, SF, with_reference_only=True)
    ref = F.col("packaging_resubmission_reference_number")
    assert with_ref.filter(ref.isNotNull()).count() == plain.filter(ref.isNotNull()).count()
