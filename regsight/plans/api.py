"""Request bodies in, paginated responses out, for the three list reports.

A user of the reference sends a JSON request body and receives
``{items, currentPage, totalItems, pageSize}``. These functions take the
same body (a dict with the request's camelCase field names), run the
report, and build the same envelope. Only the page is collected to the
driver, and a page holds at most ``pageSize`` rows. No HTTP is involved.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from regsight.functions import normalise as N
from regsight.operators import aggregate as A
from regsight.operators import joins as J
from regsight.operators import paging as W
from regsight.plans import reports as R
from regsight.sources import standin as V
from regsight.sources.export import camel_case

# Fixed field names of the request bodies (the reference's request models).
POM_DECISION_FIELDS = ("FileId", "Decision", "Comments", "IsResubmissionRequired")
REGISTRATION_DECISION_FIELDS = ("FileId", "Decision", "Comments")


def _decisions_text(delta, fields) -> str:
    """The decisions array as the report receives it: PascalCase fields; null -> []."""
    by_lower = {f.lower(): f for f in fields}
    entries = [{by_lower[k.lower()]: v for k, v in entry.items() if k.lower() in by_lower}
               for entry in (delta or [])]
    return json.dumps(entries)


def _json_value(value):
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def page_response(page: W.Page) -> dict:
    """The paginated envelope; the total is read from the page rows (0 when empty)."""
    rows = page.items.collect()
    total = page.known_total if page.known_total is not None else (
        int(rows[0]["total_items"]) if rows else 0)
    items = [{camel_case(k): _json_value(v) for k, v in row.asDict().items() if k != "total_items"}
             for row in rows]
    return {"items": items, "currentPage": page.current_page, "totalItems": total,
            "pageSize": page.page_size}


def _user_key(user_id) -> int | None:
    """The numeric key of a request's regulator user (a number or a GUID text); an unknown user is -1."""
    if user_id is None or not str(user_id).strip():
        return None
    text = str(user_id).strip()
    key = int(text) if text.isdecimal() else V.key_of_file_id(text)
    return -1 if key is None else key


def _summary_args(body: dict, fields) -> dict:
    return dict(decisions=_decisions_text(body.get("decisionsDelta"), fields),
                organisation_name=body.get("organisationName"),
                organisation_reference=body.get("organisationReference"),
                statuses=body.get("statuses"),
                organisation_type=body.get("organisationType"),
                years=body.get("submissionYears"),
                periods=body.get("submissionPeriods"),
                user_id=_user_key(body.get("userId")),
                page_size=int(body.get("pageSize", 0)),
                page_number=int(body.get("pageNumber", 0)))


def pom_summaries(spark: SparkSession, sf_dir: str, body: dict) -> dict:
    """Q1 for a POM submissions request body."""
    return page_response(R.pom_summaries(spark, sf_dir, **_summary_args(body, POM_DECISION_FIELDS)))


def registration_summaries(spark: SparkSession, sf_dir: str, body: dict) -> dict:
    """Q2 for a registration submissions request body."""
    return page_response(R.registration_summaries(
        spark, sf_dir, **_summary_args(body, REGISTRATION_DECISION_FIELDS)))


def organisation_registrations(spark: SparkSession, sf_dir: str, nation_id: int,
                               query: dict) -> dict:
    """Q5 for a nation and a filter request (relevant years are submission year + 1)."""
    relevant = query.get("relevantYearCommaSeparated")
    years = None
    if relevant:
        years = ",".join(str(int(y) - 1) for y in relevant.split(",") if y.strip())
    page = R.organisation_registration_summaries(
        spark, sf_dir, names=query.get("organisationNameCommaSeparated"),
        references=query.get("organisationIDCommaSeparated"), years=years,
        statuses=query.get("submissionStatusCommaSeparated"),
        resubmission_statuses=query.get("resubmissionStatusCommaSeparated"),
        org_types=query.get("organisationTypesCommaSeparated"), nation_id=nation_id,
        app_refs=query.get("applicationReferenceNumbers"),
        page_size=int(query.get("pageSize", 0)), page_number=int(query.get("pageNumber", 0)))
    return page_response(page)


# Single-id questions (scalar answers) ------------------------------------------
def sync_available(spark: SparkSession, sf_dir: str, submission_id=None, file_id=None) -> bool:
    """Q8 for a submission, a file, or both (a row must match each given id). No row -> False."""
    if submission_id is None and file_id is None:
        raise ValueError("give a submission id or a file id")
    flags = R.of_file(R.sync_available(spark, sf_dir), file_id)
    if submission_id is not None:
        flags = flags.filter(F.col("submission_id") == submission_id)
    if file_id is not None:
        flags = flags.filter(F.col("file_id") == str(file_id).strip().lower())
    row = flags.select("is_synced").first()
    return bool(row[0]) if row is not None and row[0] is not None else False


def resubmission_synchronised(spark: SparkSession, sf_dir: str, file_id: str) -> bool:
    """Q9 for one file: arrived and known with a resubmission reference."""
    if not file_id or not str(file_id).strip():
        raise ValueError("file id must not be empty")
    row = R.resubmission_synchronised(spark, sf_dir, file_id).select("is_synchronised").first()
    return bool(row[0]) if row is not None and row[0] is not None else False


def actual_submission_period(spark: SparkSession, sf_dir: str, request_id: str,
                             period_label: str) -> str:
    """Q10 for one submission id (digits) or file id: the stored actual period,
    else the (URL-decoded) requested one."""
    stored = R.stored_actual_periods(spark, sf_dir)
    plain = str(request_id).strip()
    if plain.isdecimal():
        stored = stored.filter(F.col("submission_id") == int(plain))
        stored = stored.select(F.col("submission_id").cast("string").alias("id"), "stored_period")
    else:
        plain = plain.lower()
        stored = R.of_file(stored, plain).select(F.col("file_id").alias("id"), "stored_period")
    request = spark.createDataFrame([(plain, period_label)], "id string, label string")
    request = request.select(N.sanitise_id("id").alias("id"), N.decode_period("label").alias("requested_period"))
    out = J.lookup_period(request, stored, "id", "stored_period", "requested_period")
    return out.select(F.col("actual_submission_period")).first()[0]


def last_sync_time(spark: SparkSession, sf_dir: str) -> dt.datetime:
    """Q16: the latest load time; an empty event store is an error."""
    return A.last_sync_time_value(V.submission_events(spark, sf_dir))
