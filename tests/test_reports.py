"""Report parameters: filters, request-shaped inputs and validation."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from regsight.plans import catalog as C
from regsight.plans import reports as R
from regsight.sources import standin as V

ALL = 10 ** 6  # one page holding every row


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_pom_summaries_filters_match_unfiltered(spark, sf_small):
    everything = R.pom_summaries(spark, sf_small, page_size=ALL).items.collect()
    page = R.pom_summaries(spark, sf_small, statuses="Rejected,Pending", organisation_type="CS",
                           page_size=ALL)
    want = sorted(r.submission_id for r in everything
                  if r.decision in ("Rejected", "Pending") and r.organisation_type == "CS")
    got = page.items.collect()
    assert sorted(r.submission_id for r in got) == want
    assert page.total_items() == len(want) and all(r.total_items == len(want) for r in got)


def test_pom_summaries_name_reference_year_period(spark, sf_small):
    everything = R.pom_summaries(spark, sf_small, page_size=ALL).items.collect()
    target = everything[0]
    by_ref = R.pom_summaries(spark, sf_small, organisation_reference=str(target.organisation_reference),
                             page_size=ALL).items.collect()
    assert {r.organisation_id for r in by_ref} == {target.organisation_id}
    by_name = R.pom_summaries(spark, sf_small, organisation_name=target.organisation_name.upper(),
                              page_size=ALL).items.collect()
    assert target.submission_id in {r.submission_id for r in by_name}
    years = R.pom_summaries(spark, sf_small, years="2025", periods="2025-H2",
                            page_size=ALL).items.collect()
    want = {r.submission_id for r in everything
            if r.submission_year == 2025 and r.actual_submission_period == "2025-H2"}
    assert {r.submission_id for r in years} == want


def test_pom_summaries_json_delta_last_entry_wins(spark, sf_small):
    base = R.pom_summaries(spark, sf_small, decisions="[]", page_size=ALL).items
    first = base.orderBy("submission_id").first()
    delta = json.dumps([
        {"FileId": first.file_id, "Decision": "Rejected", "Comments": "first",
         "IsResubmissionRequired": False},
        {"FileId": first.file_id, "Decision": "Accepted", "Comments": "second",
         "IsResubmissionRequired": True},
        {"FileId": "00000000-0000-4000-8000-999999999999", "Decision": "Rejected",
         "Comments": "nobody", "IsResubmissionRequired": True}])
    page = R.pom_summaries(spark, sf_small, decisions=delta, page_size=ALL)
    row = page.items.filter(F.col("file_id") == first.file_id).first()
    assert (row.decision, row.comments, row.is_resubmission_required) == ("Accepted", "second", True)
    assert page.items.count() == base.count()


@pytest.mark.parametrize("text", ["", "  ", "[]"])
def test_empty_delta_changes_nothing(spark, sf_small, text):
    stored = R.pom_summaries(spark, sf_small, decisions="[]", page_size=ALL).items
    other = R.pom_summaries(spark, sf_small, decisions=text, page_size=ALL).items
    assert _rows(stored, "submission_id", "decision") == _rows(other, "submission_id", "decision")


def test_registration_summaries_page_past_end(spark, sf_small):
    page = R.registration_summaries(spark, sf_small, page_number=10 ** 5, page_size=50)
    assert page.items.count() == 0 and page.total_items() == 0 and page.current_page == 10 ** 5


def test_org_registration_summaries_filters(spark, sf_small):
    everything = R.organisation_registration_summaries(
        spark, sf_small, years=None, statuses=None, page_size=ALL).items.collect()
    page = R.organisation_registration_summaries(
        spark, sf_small, years="2026", statuses="Accepted", nation_id=2, org_types="DP",
        page_size=ALL)
    want = sorted(r.submission_id for r in everything
                  if r.relevant_year == 2027 and r.submission_status == "Accepted"
                  and r.nation_id == 2 and r.organisation_type == "DP")
    assert sorted(r.submission_id for r in page.items.collect()) == want
    with pytest.raises(ValueError):
        R.organisation_registration_summaries(spark, sf_small, nation_id=7)


def test_org_registration_summaries_clamps(spark, sf_small):
    page = R.organisation_registration_summaries(spark, sf_small, page_size=10, page_number=10 ** 4)
    total = page.total_items()
    assert page.current_page == max(1, -(-total // 10))
    assert 0 < page.items.count() <= 10


def test_detail_single_id_equals_bulk_row(spark, sf_small):
    bulk = R.organisation_registration_detail(spark, sf_small)
    some = bulk.orderBy("submission_id").first()
    one = R.organisation_registration_detail(spark, sf_small, some.submission_id).collect()
    assert len(one) == 1 and one[0].asDict() == some.asDict()
    assert R.organisation_registration_detail(spark, sf_small, -1).count() == 0
    with pytest.raises(ValueError):
        R.organisation_registration_detail(spark, sf_small, " ")


def test_detail_ids_frame(spark, sf_small):
    ids = V.submissions(spark, sf_small, kind="Registration").select("submission_id").limit(3)
    wanted = {r.submission_id for r in ids.collect()}
    got = R.organisation_registration_detail(spark, sf_small, ids)
    assert {r.submission_id for r in got.collect()} == wanted


def test_pay_parameters_scheme_filter(spark, sf_small):
    everything = R.resubmission_pay_parameters(spark, sf_small).collect()
    assert {r.outcome for r in everything} <= {"ready", "no_content", "reference_missing"}
    orgs = {r.organisation_id: r.organisation_type
            for r in V.organisations(spark, sf_small).collect()}
    subs = {r.submission_id: r.organisation_id for r in V.submissions(spark, sf_small).collect()}
    ready = [r for r in everything if r.outcome != "no_content"]
    scheme = next(subs[r.submission_id] for r in ready if orgs[subs[r.submission_id]] == "CS")
    filtered = R.resubmission_pay_parameters(spark, sf_small, compliance_scheme_id=scheme).collect()
    found = {r.submission_id for r in filtered if r.outcome != "no_content"}
    assert found and all(subs[s] == scheme for s in found)


def test_fee_details_single_file(spark, sf_small):
    bulk = R.registration_fee_details(spark, sf_small)
    some = bulk.orderBy("file_id").first()
    one = R.registration_fee_details(spark, sf_small, some.file_id).collect()
    assert [r.asDict() for r in one] == [some.asDict()]


def test_updated_producers_window(spark, sf_small):
    assert R.updated_producers(spark, sf_small, "2025-01-10 00:00:00", "2025-01-05 00:00:00").count() == 0
    rows = R.updated_producers_v2(spark, sf_small, C.Q11_FROM, C.Q11_TO).collect()
    assert rows and all(r.registration_year == "2025" for r in rows)


@pytest.mark.parametrize("year", [2024, None, 10000])
def test_extracts_reject_bad_year(spark, sf_small, year):
    with pytest.raises(ValueError):
        R.paycal_poms(spark, sf_small, year)
    with pytest.raises(ValueError):
        R.paycal_organisations(spark, sf_small, year)


def test_paycal_poms_year_rule(spark, sf_small):
    rows = R.paycal_poms(spark, sf_small, 2026).collect()
    assert rows and {r.submission_period[:4] for r in rows} == {"2025"}
    assert {r.submission_period_description.split(" ")[-1] for r in rows} == {"2025"}


def test_approved_by_periods_and_as_of(spark, sf_small):
    explicit = R.approved_submissions(spark, sf_small, approved_after=C.Q3_APPROVED_AFTER,
                                      periods="2024-P1,2024-P4")
    derived = C.q3(spark, sf_small)  # as of 2025-06-01 -> 2024 periods
    cols = explicit.columns
    assert _rows(explicit, *cols) == _rows(derived, *cols)
    assert {r.submission_period for r in explicit.collect()} <= {"2024-P1", "2024-P4"}


def test_approved_report_flag_and_validation(spark, sf_small):
    import datetime as dt
    with pytest.raises(ValueError, match="valid UTC datetime"):
        R.approved_submissions_report(spark, sf_small, "invalid date string", dt.date(2026, 6, 1))
    by_year = R.approved_submissions_report(spark, sf_small, "2024-03-01T00:00:00Z", dt.date(2026, 6, 1))
    cols = by_year.columns
    assert _rows(by_year, *cols) == _rows(R.approved_submissions_by_year(spark, sf_small, 2025), *cols)
    old = R.approved_submissions_report(spark, sf_small, "2024-03-01", dt.date(2025, 6, 1), by_year=False)
    assert _rows(old, *cols) == _rows(C.q3(spark, sf_small), *cols)


def test_decisions_request_round_trip(spark, sf_small):
    from regsight.operators import project as PR
    events = R.decisions_from_events(spark, sf_small)
    text = PR.encode_decisions_request(
        events, [F.col("file_id").alias("FileId"), F.col("decision").alias("Decision"),
                 F.col("comments").alias("Comments"),
                 F.col("is_resubmission_required").alias("IsResubmissionRequired")],
        order_cols=["load_ts", "submission_event_id"])
    from_text = R.pom_summaries(spark, sf_small, decisions=text, page_size=ALL).items
    from_frame = R.pom_summaries(spark, sf_small, page_size=ALL).items
    cols = ["submission_id", "decision", "comments", "is_resubmission_required"]
    assert _rows(from_text, *cols) == _rows(from_frame, *cols)
    assert PR.encode_decisions_request(events.limit(0), ["file_id"]) == "[]"
    with pytest.raises(ValueError):
        PR.encode_decisions_request(events, ["file_id"], max_rows=3)


def test_decisions_frame_with_own_order(spark, sf_small):
    first = R.pom_summaries(spark, sf_small, decisions="[]", page_size=ALL).items \
        .orderBy("submission_id").first()
    delta = spark.createDataFrame(
        [(first.file_id, "Rejected", "late", True, 2), (first.file_id, "Accepted", "early", False, 1)],
        "file_id string, decision string, comments string, is_resubmission_required boolean, seq int")
    page = R.pom_summaries(spark, sf_small, decisions=delta, decision_order=["seq"], page_size=ALL)
    row = page.items.filter(F.col("file_id") == first.file_id).first()
    assert (row.decision, row.comments, row.is_resubmission_required) == ("Rejected", "late", True)
    with pytest.raises(ValueError, match="lacks columns"):
        R.pom_summaries(spark, sf_small, decisions=delta.drop("seq"), page_size=ALL)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_counts_do_not_read_part(spark, sf_small):
    for df in (R.organisation_registration_detail(spark, sf_small), R.registration_fee_details(spark, sf_small),
               R.resubmission_pay_parameters(spark, sf_small)):
        assert "l_orderkey" in _plan(df) and "p_partkey" not in _plan(df)


def test_single_ids_reach_the_scans(spark, sf_small):
    every = {r.submission_id: r for r in R.organisation_registration_detail(spark, sf_small).collect()}
    one = sorted(every)[3]
    got = R.organisation_registration_detail(spark, sf_small, one)
    assert got.collect() == [every[one]]
    assert f"= {one})" in _plan(got)
    file_id = every[one].company_details_file_id
    fees = R.registration_fee_details(spark, sf_small, file_id)
    want = [r for r in R.registration_fee_details(spark, sf_small).collect() if r.file_id == file_id]
    assert want and sorted(fees.collect()) == sorted(want) and f"= {one})" in _plan(fees)


def test_approved_after_is_the_decision_instant(spark, sf_small):
    periods = "2025-H1"
    subs = V.submissions(spark, sf_small, kind="Producer").filter("status = 'Accepted'").filter(
        F.col("submission_period") == periods)
    when = subs.agg(F.max("submitted_at")).first()[0]
    # after the last submission, before its decision
    assert R.approved_submissions(spark, sf_small, when + dt.timedelta(days=13), periods, org_size=None).count() > 0
    assert R.approved_submissions(spark, sf_small, when + dt.timedelta(days=14), periods, org_size=None).count() == 0


def test_list_pages_compute_history_for_the_page_only(spark, sf_small, monkeypatch):
    asked, real = [], R.with_history

    def recorded(subs, ids=None, few=False):
        asked.append(None if ids is None else ids.count())
        return real(subs, ids, few)

    monkeypatch.setattr(R, "with_history", recorded)
    R.pom_summaries(spark, sf_small, page_size=5)
    R.registration_summaries(spark, sf_small, page_size=5)
    R.organisation_registration_summaries(spark, sf_small, page_size=5)
    assert asked == [5, 5, 5]
