"""Registry: one callable ``(spark, sf_dir) -> DataFrame`` per SURVEY section 2 row.

Each entry runs over whole tables. Parameters are fixed here so that the
oracle SQL (``regsight.plans.oracle``) can state the same query. Paged
reports return their page rows with the response metadata as columns.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regsight.functions import normalise as N
from regsight.functions import scalar as P
from regsight.operators import aggregate as A
from regsight.operators import changes as CH
from regsight.operators import filters as FL
from regsight.operators import joins as J
from regsight.operators import name_index as NI
from regsight.operators import page_directory as PD
from regsight.operators import paging as W
from regsight.operators import project as PR
from regsight.plans import reports as R
from regsight.plans import sql_functions as SQ
from regsight.session import scratch_path
from regsight.sources import export as X
from regsight.sources import resumable as XR
from regsight.sources import standin as V
from regsight.sources import tables as TB

# Fixed parameters of the registered queries (the oracle uses the same).
Q1_PAGE, Q1_SIZE = 2, 20
Q2_PAGE, Q2_SIZE = 3, 20
Q5_PAGE, Q5_SIZE = 1000, 20
L1_PAGE, L1_SIZE = 3, 25
L2_PAGE, L2_SIZE = 100000, 20
F1_PERIODS = "2025-H1,2026-H2"
F2_NATION = 2
F3_NAME = "00000001"
F4_AFTER = "2027-06-30 12:00:00"
F5_FROM, F5_TO = "2025-01-01 00:00:00", "2025-03-31 23:59:59"
RELATIVE_YEAR = 2026
Q3_APPROVED_AFTER, Q3_AS_OF = "2024-03-01 00:00:00", dt.date(2025, 6, 1)
Q4_AS_OF = dt.date(2026, 6, 1)
Q5_YEARS, Q5_STATUSES = "2025,2026", "Accepted,Pending"
EXPORT_PARTS = 12
DIRECTORY_SIZE = 150
INDEX_NAME = "MER#0000000"
# a request with filters: the page holds all its rows at the checked sizes
LIST_SIZE, LIST_USER = 2000, 3
LIST_NAME, LIST_TYPE, LIST_STATUSES = "00", "CS", "Rejected, Pending"
LIST_YEARS, LIST_PERIODS = "2025,2026", "2025-H1,2026-H2"
LIST_DELTA_KEYS = 2000
Q11_FROM, Q11_TO = "2025-01-01 00:00:00", "2025-06-30 23:59:59"


def _page_frame(page: W.Page) -> DataFrame:
    return page.items.withColumn("current_page", F.lit(page.current_page).cast("int"))


# --- end-to-end reports ------------------------------------------------------
def q1(spark, d):
    return _page_frame(R.pom_summaries(spark, d, page_number=Q1_PAGE, page_size=Q1_SIZE))


def q2(spark, d):
    return _page_frame(R.registration_summaries(spark, d, page_number=Q2_PAGE, page_size=Q2_SIZE))


def q5(spark, d):
    return _page_frame(R.organisation_registration_summaries(
        spark, d, years=Q5_YEARS, statuses=Q5_STATUSES, page_number=Q5_PAGE, page_size=Q5_SIZE))


def decisions_request(keys: int = LIST_DELTA_KEYS) -> str:
    """A request's JSON delta: an entry for every fourth key, and for some a later one that wins."""
    entries = [{"FileId": V.FILE_ID_PREFIX.upper() + f"{k:012d}", "Decision": "Rejected" if k % 3 else "Accepted",
                "Comments": None if k % 5 == 0 else f"delta {k}", "IsResubmissionRequired": k % 8 == 0}
               for k in range(4, keys, 4)]
    entries += [{"FileId": V.FILE_ID_PREFIX + f"{k:012d}", "Decision": "Pending", "Comments": f"again {k}"}
                for k in range(20, keys, 20)]
    return json.dumps(entries)


LIST_REQUEST = dict(organisation_name=LIST_NAME, organisation_type=LIST_TYPE, statuses=LIST_STATUSES,
                    years=LIST_YEARS, periods=LIST_PERIODS, user_id=LIST_USER)


def q1_request(spark, d):
    return _page_frame(R.pom_summaries(spark, d, decisions=decisions_request(), page_size=LIST_SIZE, **LIST_REQUEST))


def q2_request(spark, d):
    request = {k: v for k, v in LIST_REQUEST.items() if k != "organisation_type"}
    return _page_frame(R.registration_summaries(spark, d, decisions=decisions_request(), page_size=LIST_SIZE,
                                                **request))


# --- the same reports as SQL table functions -----------------------------------
def _sql(query: str, **args):
    return lambda spark, d: SQ.call(spark, d, query, args or None)


def _listed(fn: str, date: str, request: dict) -> Callable:
    named = ", ".join(f"{k} => :{k}" for k in request)
    query = f"""SELECT *, count(*) OVER () AS total_items, 1 AS current_page
        FROM {fn}({named}, decisions_delta => :delta) ORDER BY {date} DESC, submission_id LIMIT {LIST_SIZE}"""
    return lambda spark, d: SQ.call(spark, d, query, {**request, "delta": decisions_request()})


SQL_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "sql_pom_summaries": _listed("pom_summaries", "submitted_date", LIST_REQUEST),
    "sql_registration_summaries": _listed("registration_summaries", "registration_date", {
        k: v for k, v in LIST_REQUEST.items() if k != "organisation_type"}),
    "sql_approved_submissions": _sql(
        "SELECT * FROM approved_submissions(approved_after => CAST(:after AS TIMESTAMP_NTZ), periods => :periods)",
        after=Q3_APPROVED_AFTER, periods=P.periods_for_year(P.derive_period_year(Q3_AS_OF))),
    "sql_approved_submissions_by_year": _sql("SELECT * FROM approved_submissions_by_year(period_year => :year)",
                                             year=P.derive_period_year(Q4_AS_OF)),
    "sql_organisation_registration_summaries": _sql(
        "SELECT * FROM organisation_registration_summaries(years => :years, statuses => :statuses)",
        years=Q5_YEARS, statuses=Q5_STATUSES),
    "sql_organisation_registration_detail": _sql("SELECT * FROM organisation_registration_details()"),
    "sql_resubmission_pay_parameters": _sql("""
        SELECT r.submission_id, is_resubmission, resubmission_date, member_count, reference, nation_code,
               true AS reference_field_available, coalesce(outcome, 'no_content') AS outcome
        FROM (SELECT DISTINCT submission_id FROM rs_events) r
             LEFT JOIN resubmission_pay_parameters_of_all() p ON r.submission_id = p.submission_id"""),
    "sql_sync_available": _sql("""SELECT s.submission_id, s.file_id, f.is_synced
        FROM rs_submissions s, LATERAL sync_available(submission_id => s.submission_id) f"""),
    "sql_resubmission_synchronised": _sql("""SELECT s.file_id, f.is_synchronised
        FROM rs_submissions s, LATERAL resubmission_synchronised(file_id => s.file_id) f"""),
    "sql_actual_submission_period": _sql("""SELECT s.submission_id, f.actual_submission_period
        FROM rs_submissions s, LATERAL actual_submission_period(s.submission_id, 'January+to%20June') f"""),
    "sql_updated_producers": _sql("""SELECT * FROM updated_producers(
        from_date => CAST(:start AS TIMESTAMP_NTZ), to_date => CAST(:end AS TIMESTAMP_NTZ))""",
                                  start=Q11_FROM, end=Q11_TO),
    "sql_updated_producers_v2": _sql("""SELECT * FROM updated_producers_v2(
        from_date => CAST(:start AS TIMESTAMP_NTZ), to_date => CAST(:end AS TIMESTAMP_NTZ))""",
                                     start=Q11_FROM, end=Q11_TO),
    "sql_registration_fee_details": _sql("""SELECT f.*
        FROM (SELECT file_id FROM rs_submissions WHERE submission_type = 'Registration') s,
             LATERAL registration_fee_details(file_id => s.file_id) f"""),
    "sql_paycal_organisations": _sql("SELECT * FROM paycal_organisations(relative_year => :year)",
                                     year=RELATIVE_YEAR),
    "sql_paycal_poms": _sql("SELECT * FROM paycal_poms(relative_year => :year)", year=RELATIVE_YEAR),
    "sql_last_sync_time": _sql("SELECT * FROM last_sync_time()"),
}


def q3(spark, d):
    return R.approved_submissions(spark, d, approved_after=Q3_APPROVED_AFTER, as_of=Q3_AS_OF)


def q4(spark, d):
    return R.approved_submissions_by_year(spark, d, as_of=Q4_AS_OF)


# --- S: scans, sources, sinks -----------------------------------------------
def s2_align(spark, d):
    target = T.StructType([
        T.StructField("submission_id", T.LongType(), False),
        T.StructField("FILE_ID_TEXT", T.StringType(), True),
        T.StructField("key_text", T.IntegerType(), True),
        T.StructField("status_int", T.IntegerType(), False),
        T.StructField("comments", T.StringType(), True),
        T.StructField("is_valid", T.BooleanType(), False),
    ])
    out = N.align_schema(V.raw_text(spark, d), target)
    return out.withColumnRenamed("FILE_ID_TEXT", "file_id_text")


def s3_evolve(spark, d):
    old_vintage = V.submission_events(spark, d).select(
        "submission_event_id", "load_ts", "submission_id", "decision")
    return N.evolve_schema(old_vintage, {
        "decision": T.StringType(), "is_resubmission_required": T.BooleanType(),
        "comments": T.StringType(), "packaging_resubmission_reference_number": T.StringType()})


def s4_ndjson(spark, d):
    return X.ndjson_lines(R.paycal_organisations(spark, d, RELATIVE_YEAR))


def s5_summary(spark, d):
    extract = R.paycal_poms(spark, d, RELATIVE_YEAR)
    summary = X.export_with_summary(extract, scratch_path(spark, "paycal-poms"))
    return spark.createDataFrame([(summary.records, summary.status)],
                                 "records bigint, status string")


def s5_resumed(spark, d):
    """An export stopped after half of its parts, gone on with by a second run."""
    extract, path = R.paycal_poms(spark, d, RELATIVE_YEAR), scratch_path(spark, "paycal-poms-parts")
    keys = ["organisation_id", "subsidiary_id", "submission_period", "packaging_class", "submitter_id"]
    first = XR.export_resumable(extract, path, keys, EXPORT_PARTS, only_parts=range(EXPORT_PARTS // 2))
    second = XR.export_resumable(extract, path, keys, EXPORT_PARTS)
    whole = first.records + second.written == second.records and XR.verify_export(spark, path).isEmpty()
    return spark.createDataFrame([(second.records, first.status, second.status, whole)],
                                 "records bigint, first_status string, status string, whole boolean")


# --- N: normalisation --------------------------------------------------------
def n1(spark, d):
    raw = V.raw_text(spark, d)
    return raw.select("submission_id", N.norm_guid("file_id_text", "file_id").alias("file_id"))


def n2(spark, d):
    return V.raw_text(spark, d).select("submission_id", N.norm_int("key_text").alias("key_int"))


def n3(spark, d):
    raw = V.raw_text(spark, d)
    flag = N.int_to_bool("status_int")
    return raw.select("submission_id", flag.alias("is_accepted"),
                      N.bool_to_int(flag).alias("status_flag"))


def n4(spark, d):
    raw = V.raw_text(spark, d)
    return raw.select("submission_id",
                      N.norm_timestamp("submitted_text").cast("timestamp_ntz").alias("submitted_at"))


def n5(spark, d):
    raw = V.raw_text(spark, d)
    ref = N.reference_to_int("reference_text")
    return raw.select("submission_id", ref.alias("reference"),
                      N.int_to_reference(ref).alias("reference_json"))


def n6(spark, d):
    raw = V.raw_text(spark, d)
    return N.reject_counts(raw, {
        "messy_int_text": N.try_norm_int("messy_int_text"),
        "messy_date_text": N.parse_utc_date("messy_date_text")})


def n6_report(spark, d):
    """Bad cells of a delivery per column, counted by the run of Q6 that defaults them."""
    rejects = Observation()
    R.organisation_registration_detail(spark, d, organisations=V.organisations_delivered(spark, d), rejects=rejects) \
        .write.format("noop").mode("overwrite").save()
    counts = rejects.get
    return spark.createDataFrame([(counts["rows"], counts["nation_id"], counts["is_online_market_place"])],
                                 "rows bigint, nation_id_rejects bigint, is_online_market_place_rejects bigint")


def n6_rows(spark, d):
    return R.registration_detail_rejects(spark, d, V.organisations_delivered(spark, d))


def n6_defaults(spark, d):
    """Q6 over the same delivery: the rows stay, bad cells take their defaults."""
    rows = R.organisation_registration_detail(spark, d, organisations=V.organisations_delivered(spark, d))
    return rows.select("submission_id", "nation_id", "is_online_market_place", "organisation_name")


def n7(spark, d):
    return V.raw_text(spark, d).select("submission_id", N.sanitise_id("file_id_crlf").alias("file_id"))


def n8(spark, d):
    return V.raw_text(spark, d).select("submission_id",
                                       N.decode_period("period_label").alias("period"))


def n9(spark, d):
    raw = V.raw_text(spark, d).select("submission_id", "messy_date_text")
    good, bad = N.split_parsed(raw, "messy_date_text", "approved_after")
    good = good.select("submission_id", F.col("approved_after").cast("timestamp_ntz"),
                       F.lit(None).cast("string").alias("error"))
    bad = bad.select("submission_id", F.lit(None).cast("timestamp_ntz").alias("approved_after"),
                     "error")
    return good.unionByName(bad)


# --- F: filters --------------------------------------------------------------
def f1(spark, d):
    subs = V.submissions(spark, d, kind="Producer")
    return FL.filter_csv(subs, "submission_period", F1_PERIODS).select(
        "submission_id", "submission_period")


def f2(spark, d):
    orgs = V.organisations(spark, d)
    return FL.filter_optional_eq(orgs, "nation_id", FL.validate_nation(F2_NATION)).select(
        "organisation_id", "nation_id")


def f3(spark, d):
    orgs = V.organisations(spark, d)
    return FL.filter_name(orgs, "organisation_name", F3_NAME).select(
        "organisation_id", "organisation_name")


def f4(spark, d):
    subs = V.submissions(spark, d, submitted_between=(F4_AFTER, None))
    return FL.filter_approved_after(subs, "submitted_at", F4_AFTER).select(
        "submission_id", "submitted_at")


def f5(spark, d):
    subs = V.submissions(spark, d, years=[2025], submitted_between=(F5_FROM, F5_TO))
    return FL.filter_delta_window(subs, "submitted_at", F5_FROM, F5_TO).select(
        "submission_id", "submitted_at")


def f6(spark, d):
    subs = V.submissions(spark, d, years=[RELATIVE_YEAR - 1], kind="Producer")
    return FL.filter_relative_year(subs, "submission_year", RELATIVE_YEAR, 1).select(
        "submission_id", "submission_year")


def f7(spark, d):
    subs = V.submissions(spark, d)
    return FL.filter_key(subs, "submission_id", R.requested_from_events(spark, d)).select(
        "submission_id", "file_id")


# --- P: projections and scalar functions -------------------------------------
def p1(spark, d):
    subs = V.submissions(spark, d)
    flags = A.half_year_flags(subs, ["organisation_id"])
    rows = V.organisations(spark, d).join(flags, "organisation_id", "left").select(
        "*", F.lit(None).cast("string").alias("subsidiary_id"),
        F.lit(None).cast("string").alias("error_code"),
        F.col("organisation_id").cast("string").alias("submitter_id"))
    rows = rows.withColumn("has_h1", P.fold_flag("has_h1")).withColumn("has_h2", P.fold_flag("has_h2"))
    return PR.project_organisation(rows)


def p2(spark, d):
    lines = V.pom_lines(spark, d)
    rows = lines.select("*", R.period_description().alias("submission_period_description"),
                        F.col("subsidiary_key").cast("string").alias("subsidiary_id"),
                        F.col("person_id").cast("string").alias("submitter_id"))
    return PR.project_pom(rows)


def p3(spark, d):
    return V.organisations(spark, d).select(
        "organisation_id", F.col("organisation_size").alias("size_code"),
        P.map_org_size("organisation_size").alias("organisation_size"))


def p4(spark, d):
    subs = V.submissions(spark, d, kind="Registration").select("submission_id", "status")
    return PR.strip_bookkeeping(W.with_total_items(subs))


def p5(spark, d):
    subs = V.submissions(spark, d)
    year = P.period_year_col(F.to_date("submitted_at"))
    return subs.select("submission_id", year.cast("int").alias("period_year"),
                       P.periods_col(year).alias("periods"))


def p6(spark, d):
    return R.resubmission_pay_parameters(spark, d).select("submission_id", "outcome")


def p7(spark, d):
    subs = V.submissions(spark, d).select("submission_id")
    events = V.submission_events(spark, d).select(
        "submission_id", F.lit(True).alias("flag")).distinct()
    return subs.join(events, "submission_id", "left").select(
        "submission_id", P.fold_flag("flag").alias("is_synced"))


def p8(spark, d):
    ev = V.submission_events(spark, d)
    text = (F.when(F.col("event_type") == "view", F.lit(None).cast("string"))
            .when(F.col("event_type") == "click", F.lit("[]"))
            .otherwise(PR.encode_decisions([
                F.col("file_id").alias("FileId"), F.col("decision").alias("Decision"),
                F.col("comments").alias("Comments"),
                F.col("is_resubmission_required").alias("IsResubmissionRequired")])))
    rows = ev.select("submission_event_id", text.alias("delta"))
    decoded = PR.decode_decisions(rows, "delta", keep=("submission_event_id",))
    return decoded.select("submission_event_id", F.col("FileId").alias("file_id"),
                          F.col("Decision").alias("decision"), F.col("Comments").alias("comments"),
                          F.col("IsResubmissionRequired").alias("is_resubmission_required"))


# --- J: joins ----------------------------------------------------------------
def j1(spark, d):
    subs = V.submissions(spark, d, kind="Producer").withColumn("decision", F.col("status"))
    out = J.overlay_decisions(subs, R.decisions_from_events(spark, d, False), "file_id",
                              ["decision", "comments"], ["load_ts", "submission_event_id"])
    return out.select("submission_id", "file_id", "decision", "comments")


def j2(spark, d):
    # hot_rows=10: most organisations take the split join, so the oracle checks both parts
    rows = J.enrich_submissions(V.submissions(spark, d), V.organisations(spark, d),
                                V.persons(spark, d), hot_rows=10)
    return rows.select("submission_id", "organisation_name", "nation_id", "email")


def j3(spark, d):
    subs = V.submissions(spark, d).select("submission_id")
    return J.exists_synced(subs, V.submission_events(spark, d), "submission_id")


def j4(spark, d):
    files = V.submissions(spark, d, kind="Registration").select("file_id")
    decided = V.submission_events(spark, d, decided_only=True).filter(F.col("decision") == V.STATUS_REJECTED)
    return J.exists_both(files, V.submission_events(spark, d), decided, "file_id", "is_rejected")


def j5(spark, d):
    """Names of organisations by submission, with the reference as the fallback (null size: no stored name)."""
    subs = V.submissions(spark, d).select("submission_id", "organisation_id", "submission_period")
    stored = V.organisations(spark, d).select(
        "organisation_id", F.when(F.col("organisation_size").isNotNull(), F.col("organisation_name")).alias("stored"))
    return J.lookup_period(subs, stored, "organisation_id", "stored", "submission_period", "label")


# --- A: aggregations ---------------------------------------------------------
def _accepted_producer_lines(spark, d):
    subs = V.submissions(spark, d, kind="Producer", statuses=[V.STATUS_ACCEPTED])
    orgs = V.organisations(spark, d).select("organisation_id", "organisation_type",
                                            "num_days_obligated")
    lines = V.pom_lines(spark, d, J.enrich_submissions(subs, orgs))
    return lines.select("submission_period", "packaging_material", "organisation_id",
                        F.col("person_id").alias("submitter_id"),
                        R.submitter_type().alias("submitter_type"), "packaging_material_weight",
                        F.col("num_days_obligated").alias("number_of_days_obligated"))


def a2(spark, d):
    return A.approved_weights(_accepted_producer_lines(spark, d))


def a3(spark, d):
    return A.approved_weights_by_year(_accepted_producer_lines(spark, d))


def a4(spark, d):
    subs = V.submissions(spark, d, kind="Registration")
    return A.fee_counts(V.pom_lines(spark, d, subs, with_part=False), ["file_id", "organisation_id"],
                        "subsidiary_key",
                        {"number_of_online_subsidiaries": "is_online_marketplace_line",
                         "number_of_closed_loop_subsidiaries": "is_closed_loop_line"}, {})


def a5(spark, d):
    subs = R.with_history(V.submissions(spark, d, kind="Producer"))
    orgs = V.organisations(spark, d).select("organisation_id", "nation_code")
    return A.resubmission_parameters(J.enrich_submissions(subs, orgs), V.line_members(spark, d), "submission_id", "subsidiary_key", "submitted_at",
                                     "is_resubmission", "nation_code")


def a6(spark, d):
    return A.half_year_flags(V.submissions(spark, d), ["organisation_id", "submission_year"])


# --- W / L: windows, sort, limit ---------------------------------------------
def w1(spark, d):
    subs = V.submissions(spark, d, kind="Producer").select("submission_id")
    return W.with_total_items(subs)


def w2(spark, d):
    # hot_rows=0: every group takes the split (hot-group) path, so the oracle checks it
    subs = V.submissions(spark, d)
    out = W.resubmission_history(subs, R.HISTORY_GROUP, R.HISTORY_ORDER, "status", "comments",
                                 hot_rows=0)
    return out.select("submission_id", "is_resubmission", "previous_rejection_comments")


def l1(spark, d):
    subs = V.submissions(spark, d, kind="Producer").select("submission_id", "submitted_at", "status")
    page = W.page_plain(subs, [F.col("submitted_at").desc(), F.col("submission_id").asc()],
                        L1_PAGE, L1_SIZE)
    return _page_frame(page)


def l2(spark, d):
    subs = V.submissions(spark, d, kind="Registration").select("submission_id", "submitted_at")
    # deep_threshold=0: the registered form always takes the distributed deep-page path
    page = W.page_clamped(subs, [F.col("submitted_at").desc(), F.col("submission_id").asc()],
                          L2_PAGE, L2_SIZE, deep_threshold=0,
                          key_cols=["submitted_at", "submission_id"])
    return _page_frame(page)


def l3(spark, d):
    subs = V.submissions(spark, d).select("organisation_id", "submission_id", "submitted_at")
    return W.first_per_key(subs, "organisation_id", ["submitted_at", "submission_id"])


def l2_directory(spark, d):
    """The last page of a list from its stored order; ties and nulls in the order's first columns."""
    path, order = scratch_path(spark, "page-directory"), [F.col("half").asc_nulls_last(), F.col("submission_year").desc(),
                                                          F.col("submission_id").asc()]
    subs = V.submissions(spark, d, kind="Registration").select(
        "submission_id", "submission_year", F.when(F.col("submission_period").like("%-H%"), F.substring_index(
            "submission_period", "-", -1)).alias("half"))
    PD.write_directory(subs, path, order, range_rows=200)
    return _page_frame(PD.directory_page(spark, PD.open_directory(spark, path), order, L2_PAGE, DIRECTORY_SIZE))


def f3_index(spark, d):
    orgs, path = V.organisations(spark, d), scratch_path(spark, "name-index")
    NI.write_name_index(orgs, path, "organisation_id", "organisation_name")
    return NI.search_names(spark, path, INDEX_NAME).select(
        F.col("id").alias("organisation_id"), F.col("name").alias("organisation_name"))


def f5_changes(spark, d):
    return CH.changed_keys(V.organisation_vintage(spark, d, 1), V.organisation_vintage(spark, d, 2),
                           ["organisation_id"])


def q11_changes(spark, d):
    return R.changed_producers(spark, d, V.organisation_vintage(spark, d, 1), V.organisation_vintage(spark, d, 2),
                               Q11_TO)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # end-to-end reports
    "pom_summaries": q1,
    "registration_summaries": q2,
    "approved_submissions": q3,
    "approved_submissions_by_year": q4,
    "organisation_registration_summaries": q5,
    "organisation_registration_detail": lambda s, d: R.organisation_registration_detail(s, d),
    "resubmission_pay_parameters": lambda s, d: R.resubmission_pay_parameters(s, d),
    "sync_available": R.sync_available,
    "resubmission_synchronised": R.resubmission_synchronised,
    "actual_submission_period": R.actual_submission_period,
    "updated_producers": lambda s, d: R.updated_producers(s, d, Q11_FROM, Q11_TO),
    "updated_producers_v2": lambda s, d: R.updated_producers_v2(s, d, Q11_FROM, Q11_TO),
    "registration_fee_details": lambda s, d: R.registration_fee_details(s, d),
    "paycal_organisations": lambda s, d: R.paycal_organisations(s, d, RELATIVE_YEAR),
    "paycal_poms": lambda s, d: R.paycal_poms(s, d, RELATIVE_YEAR),
    "last_sync_time": R.last_sync_time,
    # scans, sources, sinks
    "scan_events": lambda s, d: TB.scan_events(s, d),
    "align_schema": s2_align,
    "evolve_schema": s3_evolve,
    "ndjson_export": s4_ndjson,
    "export_summary": s5_summary,
    # normalisation
    "norm_guid": n1, "norm_int": n2, "norm_bool": n3, "norm_timestamp": n4,
    "norm_reference": n5, "lenient_cells": n6, "sanitise_id": n7, "decode_period": n8,
    "parse_utc_date": n9,
    # filters
    "filter_csv": f1, "filter_optional_eq": f2, "filter_name": f3,
    "filter_approved_after": f4, "filter_delta_window": f5, "filter_relative_year": f6,
    "filter_key": f7,
    # projections
    "project_organisation": p1, "project_pom": p2, "map_org_size": p3,
    "strip_bookkeeping": p4, "derive_period_year": p5, "classify_readiness": p6,
    "fold_flag": p7, "decode_decisions": p8,
    # joins
    "overlay_decisions": j1, "enrich_submissions": j2, "exists_synced": j3,
    "exists_both": j4, "lookup_period": j5,
    # aggregations
    "max_sync_time": lambda s, d: A.max_sync_time(V.submission_events(s, d)),
    "approved_weights": a2, "approved_weights_by_year": a3, "fee_counts": a4,
    "resubmission_parameters": a5, "half_year_flags": a6,
    # windows, sort, limit
    "total_items": w1, "resubmission_history": w2, "page_plain": l1, "page_clamped": l2,
    "first_or_none": l3,
    # requests with every filter, rejects of a report, a resumed export
    "pom_summaries_request": q1_request, "registration_summaries_request": q2_request,
    "lenient_report": n6_report, "reject_rows": n6_rows, "lenient_defaults": n6_defaults,
    "export_resumed": s5_resumed, "page_from_directory": l2_directory, "filter_name_indexed": f3_index,
    "organisation_changes": f5_changes, "changed_producers": q11_changes,
    **SQL_QUERIES,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice of the build plan: approved weights (Q3)."""
    return q3(spark, sf_dir)


