"""Request bodies in, paginated envelopes out."""

import pytest

from regsight.plans import api
from regsight.plans import reports as R
from regsight.sources import standin as V


def test_pom_request_envelope_and_delta(spark, sf_small):
    base = api.pom_summaries(spark, sf_small, {"pageSize": 5, "pageNumber": 1})
    assert set(base) == {"items", "currentPage", "totalItems", "pageSize"}
    assert base["currentPage"] == 1 and base["pageSize"] == 5 and len(base["items"]) == 5
    first = base["items"][0]
    assert "fileId" in first and "isResubmission" in first and "totalItems" not in first
    body = {"pageSize": 5, "pageNumber": 1,
            "decisionsDelta": [{"fileId": first["fileId"], "decision": "Rejected",
                                "comments": "from request", "isResubmissionRequired": True}]}
    changed = api.pom_summaries(spark, sf_small, body)["items"][0]
    assert (changed["decision"], changed["comments"], changed["isResubmissionRequired"]) == \
        ("Rejected", "from request", True)
    direct = R.pom_summaries(spark, sf_small, decisions="[]", page_size=5)
    assert base["totalItems"] == direct.total_items()


def test_past_the_end_and_invalid_page(spark, sf_small):
    out = api.registration_summaries(spark, sf_small, {"pageSize": 50, "pageNumber": 10 ** 5})
    assert out["items"] == [] and out["totalItems"] == 0 and out["currentPage"] == 10 ** 5
    with pytest.raises(ValueError):
        api.registration_summaries(spark, sf_small, {"pageSize": 0, "pageNumber": 1})


def test_organisation_registrations_request(spark, sf_small):
    out = api.organisation_registrations(spark, sf_small, 2, {
        "relevantYearCommaSeparated": "2026,2027", "submissionStatusCommaSeparated": "Accepted",
        "pageSize": 10, "pageNumber": 999})
    assert 1 <= out["currentPage"] <= max(1, -(-out["totalItems"] // 10))
    assert all(i["nationId"] == 2 and i["relevantYear"] in (2026, 2027) and
               i["submissionStatus"] == "Accepted" for i in out["items"])
    with pytest.raises(ValueError):
        api.organisation_registrations(spark, sf_small, 5, {"pageSize": 10, "pageNumber": 1})


def test_single_id_questions(spark, sf_small):
    events = V.submission_events(spark, sf_small)
    arrived = events.select("submission_id", "file_id").first()
    assert api.sync_available(spark, sf_small, submission_id=arrived.submission_id) is True
    assert api.sync_available(spark, sf_small, file_id=arrived.file_id.upper()) is True
    assert api.sync_available(spark, sf_small, submission_id=-1) is False
    flags = {r.file_id: r.is_synchronised for r in R.resubmission_synchronised(spark, sf_small).collect()}
    some_file = next(iter(flags))
    assert api.resubmission_synchronised(spark, sf_small, some_file) is flags[some_file]
    assert api.resubmission_synchronised(spark, sf_small, "00000000-0000-4000-8000-999999999999") is False
    stored = R.stored_actual_periods(spark, sf_small).filter("stored_period is not null").first()
    assert api.actual_submission_period(spark, sf_small, stored.file_id + "\r\n",
                                        "July+to%20December+2025") == stored.stored_period
    assert api.actual_submission_period(spark, sf_small, "unknown",
                                        "July+to%20December+2025") == "July to December 2025"
    assert api.last_sync_time(spark, sf_small) == \
        events.agg({"load_ts": "max"}).first()[0]
    with pytest.raises(ValueError):
        api.sync_available(spark, sf_small)


def test_sync_available_by_both_ids_must_match_both(spark, sf_small):
    arrived = V.submission_events(spark, sf_small).select("submission_id", "file_id").first()
    assert api.sync_available(spark, sf_small, arrived.submission_id, arrived.file_id) is True
    assert api.sync_available(spark, sf_small, arrived.submission_id, "00000000-0000-4000-8000-999999999999") is False


def test_actual_period_by_submission_id(spark, sf_small):
    stored = R.stored_actual_periods(spark, sf_small).filter("stored_period is not null").first()
    for asked in (stored.submission_id, f"{stored.submission_id}\r\n"):
        assert api.actual_submission_period(spark, sf_small, asked, "x") == stored.stored_period
    assert api.actual_submission_period(spark, sf_small, "999999999", "July+to%20December+2025") == "July to December 2025"


def test_regulator_user_sees_the_nation_only(spark, sf_small):
    user = V.regulator_nations(spark, sf_small).orderBy("user_id").first()
    for ask in (api.pom_summaries, api.registration_summaries):
        body = {"pageSize": 1000, "pageNumber": 1}
        every = ask(spark, sf_small, body)["items"]
        seen = ask(spark, sf_small, body | {"userId": user.user_id})["items"]
        assert 0 < len(seen) < len(every)
        assert seen == [i for i in every if i["nationId"] == user.nation_id]
        assert ask(spark, sf_small, body | {"userId": "no such user"})["items"] == []
