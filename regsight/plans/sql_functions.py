"""The reports as SQL table functions with named, typed parameters.

``create_functions(spark, sf_dir)`` defines the domain views (``rs_submissions``,
``rs_organisations``, ``rs_persons``, ``rs_regulators``, ``rs_events``,
``rs_pom_lines``, ``rs_members``, ``rs_lines``) and one temporary table function per report of the session:

    SELECT * FROM updated_producers(from_date => TIMESTAMP_NTZ'2025-01-01',
                                    to_date => TIMESTAMP_NTZ'2025-06-30')
    SELECT f.* FROM files, LATERAL registration_fee_details(file_id => files.file_id) f

A function is inlined into the query that calls it, so Catalyst plans both as
one: constant arguments fold, filters on keys and years reach the scans, and a
``LATERAL`` call over many rows becomes a join. Parameters left out take their
default, and null means no filter, as an absent procedure parameter does. An
empty id or a relative year out of range fails the query.

The list functions (``pom_summaries``, ``registration_summaries``,
``organisation_registration_summaries``) return the whole filtered list; the
caller pages it with ORDER BY, LIMIT and OFFSET. They, ``organisation_registration_details``
and ``resubmission_pay_parameters_of_all`` number the submissions
of an organisation and year with a window, so one such group is one task; the
DataFrame reports (``regsight.plans.reports``) split a hot group. The functions of one
submission look at those before it only: call them for single ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from regsight import schemas
from regsight.functions import normalise as N
from regsight.operators import filters as FL
from regsight.plans import reports as R
from regsight.sources import standin as V

_TEXT = f"'{R.SUBMITTED_TEXT}'".replace("'T'", "\\'T\\'")
_SIZE = (f"CASE lower({{c}}) WHEN 's' THEN '{R.P.SIZE_SMALL}' WHEN 'l' THEN '{R.P.SIZE_LARGE}' "
         f"ELSE '{R.P.SIZE_UNKNOWN}' END")
_SUBMITTER = "CASE WHEN organisation_type = 'CS' THEN 'ComplianceScheme' ELSE 'DirectRegistrant' END"
_SHIFT = f"INTERVAL '{V.YEAR_SHIFT}' YEAR"
_SLACK = "INTERVAL '2' DAY"
_DELTA = "array<struct<FileId:string,Decision:string,Comments:string,IsResubmissionRequired:boolean>>"


def _select(schema: T.StructType, provided: dict[str, str]) -> str:
    """Select list of a result schema: given expressions, type defaults elsewhere."""
    parts = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        expr = f"CAST({provided.get(f.name, 'NULL')} AS {kind})"
        default = next((v for cls, v in N._DEFAULTS.items() if isinstance(f.dataType, cls)), None)
        if not f.nullable and default is not None:
            expr = f"coalesce({expr}, CAST({str(default).lower()} AS {kind}))"
        parts.append(f"{expr} AS {f.name}")
    return ", ".join(parts)


def _listed(column: str, csv: str) -> str:
    """membership in a comma-separated parameter; null or blank is no filter."""
    return (f"({csv} IS NULL OR trim(replace({csv}, ',', ' ')) = '' "
            f"OR array_contains(transform(split({csv}, ','), x -> trim(x)), {column}))")


def _optional(column: str, value: str) -> str:
    return f"({value} IS NULL OR {column} = {value})"


def _file_key(value: str) -> str:
    """The numeric key behind a file id, which the scan can skip on (null for a foreign id, an error for none)."""
    text = f"lower(trim({value}))"
    return (f"CASE WHEN {text} = '' THEN CAST(raise_error('file id must not be empty') AS BIGINT) "
            f"WHEN startswith({text}, '{V.FILE_ID_PREFIX}') "
            f"THEN try_cast(substr({text}, {len(V.FILE_ID_PREFIX) + 1}) AS BIGINT) END")


def _year(value: str) -> str:
    low, high = FL.MIN_RELATIVE_YEAR, FL.MAX_RELATIVE_YEAR
    return (f"CASE WHEN {value} BETWEEN {low} AND {high} THEN {value} "
            f"ELSE raise_error('relative year must be between {low} and {high}') END")


def _within_year(year: str) -> str:
    """A submission year, with the range of raw dates that holds it."""
    start = f"CAST(make_date({year} - {V.YEAR_SHIFT}, 1, 1) AS TIMESTAMP_NTZ)"
    return (f"submission_year = {year} AND raw_date >= {start} - {_SLACK} "
            f"AND raw_date < {start} + INTERVAL '1' YEAR + {_SLACK}")


def _approved(fn: str, keys: str, days: str, where: str) -> str:
    return f"""
SELECT submission_period, packaging_material, organisation_id, submitter_id, submitter_type,
       CAST(sum(CAST(packaging_material_weight AS DECIMAL(18, 2))) AS BIGINT) AS packaging_material_weight,
       {days} AS number_of_days_obligated
FROM (SELECT l.*, person_id AS submitter_id, {_SUBMITTER} AS submitter_type, num_days_obligated
      FROM rs_pom_lines l JOIN rs_organisations o ON l.organisation_id = o.organisation_id
      WHERE submission_type = 'Producer' AND status = '{V.STATUS_ACCEPTED}' AND {where}
        AND {_listed('packaging_type', f'{fn}.types')} AND {_listed('packaging_material', f'{fn}.materials')})
GROUP BY submission_period, packaging_material, organisation_id, submitter_id, submitter_type{keys}"""


def _updated(fn: str, schema: T.StructType) -> str:
    provided = {f.name: f.name for f in schema.fields if f.name in (
        "organisation_name", "trading_name", "organisation_type", "companies_house_number", "country", "postcode",
        "business_country")}
    provided |= {"organisation_id": "o.organisation_id", "status": "last.status",
                 "peprid": "'PRD' || lpad(CAST(o.organisation_id AS STRING), 8, '0')",
                 "updated_date_time": "last.submitted_at", "registration_year": "year(last.submitted_at)"}
    return f"""
SELECT {_select(schema, provided)}
FROM (SELECT organisation_id, max_by(struct(submitted_at, status), struct(submitted_at, submission_id)) AS last
      FROM rs_submissions
      WHERE submitted_at BETWEEN {fn}.from_date AND {fn}.to_date
        AND raw_date >= {fn}.from_date - {_SHIFT} - {_SLACK} AND raw_date <= {fn}.to_date - {_SHIFT} + {_SLACK}
      GROUP BY organisation_id) u JOIN rs_organisations o ON u.organisation_id = o.organisation_id"""


def _history(kind: str) -> str:
    return f"""
(SELECT *, row_number() OVER w > 1 AS is_resubmission,
        lag(CASE WHEN status = '{V.STATUS_REJECTED}' THEN comments END) OVER w AS previous_rejection_comments
 FROM rs_submissions WHERE submission_type = '{kind}'
 WINDOW w AS (PARTITION BY organisation_id, submission_year ORDER BY submitted_at, submission_id)) s"""


def _summaries(fn: str, kind: str, schema: T.StructType, date_col: str, provided: dict[str, str]) -> str:
    """Q1/Q2 without paging: the stored rows, the request's pending decisions, the filters."""
    provided = {f.name: f.name for f in schema.fields if f.name in (
        "file_id", "submission_id", "organisation_name", "organisation_reference", "organisation_type", "first_name",
        "last_name", "email", "telephone", "service_role", "submission_period", "submission_year",
        "is_resubmission", "previous_rejection_comments", "nation_id", "postcode", "country",
        "companies_house_number")} | {
        "organisation_id": "s.organisation_id", "user_id": "s.person_id",
        "compliance_scheme_id": "CASE WHEN organisation_type = 'CS' THEN s.organisation_id END",
        "nation_id": "o.nation_id", "producer_type": _SIZE.format(c="organisation_size"), "actual_submission_period": "submission_period",
        date_col: f"date_format(submitted_at, {_TEXT})", "decision": "decision", "comments": "new_comments",
        "is_resubmission_required": "d.IsResubmissionRequired"} | provided
    delta = f"from_json(coalesce(nullif(trim({fn}.decisions_delta), ''), '[]'), '{_DELTA}', map('mode', 'FAILFAST'))"
    return f"""
SELECT {_select(schema, provided)}
FROM (SELECT s.*, coalesce(d.Decision, status) AS decision, coalesce(d.Comments, comments) AS new_comments
      FROM (SELECT s.*, try_element_at(filter({delta}, x -> lower(trim(x.FileId)) = s.file_id), -1) AS d
            FROM {_history(kind)}) s) s
     JOIN rs_organisations o ON s.organisation_id = o.organisation_id
     LEFT JOIN rs_persons p ON s.person_id = p.person_id
     LEFT JOIN rs_regulators r ON r.user_id = {fn}.user_id
WHERE {_listed('decision', f'{fn}.statuses')} AND {_optional('organisation_type', f'{fn}.organisation_type')}
  AND {_listed('CAST(submission_year AS STRING)', f'{fn}.years')} AND {_listed('submission_period', f'{fn}.periods')}
  AND (nullif({fn}.organisation_name, '') IS NULL
       OR contains(lower(organisation_name), lower({fn}.organisation_name)))
  AND {_optional('organisation_reference', f"nullif({fn}.organisation_reference, '')")}
  AND ({fn}.user_id IS NULL OR r.nation_id = o.nation_id)"""


_REGISTRATION = {f: f for f in (
    "organisation_type", "organisation_name", "organisation_reference", "nation_id",
    "is_resubmission", "submission_period", "organisation_size", "nation_code", "companies_house_number", "country",
    "postcode", "first_name", "last_name", "email", "telephone", "service_role", "number_of_subsidiaries",
    "number_of_online_subsidiaries", "number_of_subsidiaries_closed_loop_recycling")} | {
    "submission_id": "s.submission_id", "organisation_id": "s.organisation_id",
    "registration_journey": "CASE WHEN organisation_type = 'CS' THEN 'CsoLargeProducer' WHEN organisation_size = 'L' "
                            "THEN 'DirectLargeProducer' ELSE 'DirectSmallProducer' END",
    "submission_status": "status",
    "status_pending_date": f"CASE WHEN status = '{V.STATUS_PENDING}' THEN date_format(submitted_at, {_TEXT}) END",
    "application_reference_number": "'APP' || lpad(CAST(s.submission_id AS STRING), 8, '0')",
    "registration_reference_number": f"CASE WHEN status = '{V.STATUS_ACCEPTED}' THEN 'R' || submission_year || "
                                     "lpad(CAST(s.organisation_id AS STRING), 6, '0') END",
    "relevant_year": "submission_year + 1", "submitted_date_time": f"date_format(submitted_at, {_TEXT})",
    "regulator_decision_date": f"CASE WHEN status <> '{V.STATUS_PENDING}' THEN decided END",
    "resubmission_status": "CASE WHEN is_resubmission THEN status END",
    "resubmission_date": f"CASE WHEN is_resubmission THEN date_format(submitted_at, {_TEXT}) END",
    "registration_date": f"CASE WHEN status = '{V.STATUS_ACCEPTED}' THEN decided END",
    "is_late_submission": "false", "is_compliance_scheme": "organisation_type = 'CS'",
    "regulator_comment": f"CASE WHEN status = '{V.STATUS_REJECTED}' THEN comments END",
    "submitted_user_id": "s.person_id", "is_online_market_place": "is_online_marketplace",
    "company_details_file_id": "s.file_id", "company_details_blob_name": "s.file_id",
    "company_details_file_name": "'company_details_' || s.submission_id || '.csv'"}
_DECIDED = f"date_format(submitted_at + INTERVAL '{R.DECISION_DELAY.days}' DAY, {_TEXT}) AS decided"


def _one_with_history(kind: str, fn: str) -> str:
    """One submission with W2 from an aggregate over those before it, however large its group is."""
    columns = ", ".join(f"w.{c}" for c in V.SUBMISSION_COLUMNS if c != "submission_id")
    return f"""
(SELECT submission_id, {columns}, is_resubmission, previous_rejection_comments
 FROM (SELECT w.submission_id, any_value(w.w) AS w, count(e.submission_id) > 0 AS is_resubmission,
              max_by(CASE WHEN e.status = '{V.STATUS_REJECTED}' THEN e.comments END,
                     struct(e.submitted_at, e.submission_id)) AS previous_rejection_comments
       FROM (SELECT struct(*) AS w, * FROM rs_submissions
             WHERE submission_type = '{kind}' AND submission_id = {fn}.submission_id) w
       LEFT JOIN rs_submissions e
         ON e.submission_type = '{kind}' AND e.organisation_id <=> w.organisation_id
            AND e.submission_year <=> w.submission_year
            AND (e.submitted_at < w.submitted_at
                 OR e.submitted_at = w.submitted_at AND e.submission_id < w.submission_id)
       GROUP BY w.submission_id)) s"""


def _detail(source: str) -> str:
    flags = {"number_of_online_subsidiaries": "is_online_marketplace_line",
             "number_of_subsidiaries_closed_loop_recycling": "is_closed_loop_line"}
    return f"""
SELECT {_select(schemas.ORGANISATION_REGISTRATION_DETAIL, _REGISTRATION)}
FROM (SELECT *, {_DECIDED} FROM {source}) s
     JOIN rs_organisations o ON s.organisation_id = o.organisation_id
     LEFT JOIN rs_persons p ON s.person_id = p.person_id
     LEFT JOIN {_members(flags)} c ON s.submission_id = c.submission_id AND s.organisation_id = c.organisation_id"""


def _pay_parameters(source: str) -> str:
    """Q7: found is what the submissions say; lines and references may be absent."""
    return f"""
SELECT s.submission_id, is_resubmission, CASE WHEN is_resubmission THEN submitted_at END AS resubmission_date,
       coalesce(member_count, 0) AS member_count, reference, nation_code, true AS reference_field_available,
       CASE WHEN reference IS NULL OR trim(reference) = '' THEN '{R.P.REFERENCE_MISSING}' ELSE '{R.P.READY}' END
         AS outcome,
       CASE WHEN organisation_type = 'CS' THEN s.organisation_id END AS compliance_scheme_id
FROM {source}
     JOIN rs_organisations o ON s.organisation_id = o.organisation_id
     LEFT JOIN (SELECT submission_id, CAST(count(*) AS INT) AS member_count
                FROM (SELECT submission_id, subsidiary_key FROM rs_lines GROUP BY submission_id, subsidiary_key)
                GROUP BY submission_id) m ON s.submission_id = m.submission_id
     LEFT JOIN (SELECT submission_id, max_by(packaging_resubmission_reference_number,
                                             struct(load_ts, submission_event_id)) AS reference
                FROM rs_events WHERE packaging_resubmission_reference_number IS NOT NULL
                GROUP BY submission_id) e ON s.submission_id = e.submission_id"""


def _members(flags: dict[str, str], where: str = "true") -> str:
    """A4 by two aggregates: members of a file, then their counts."""
    ors = "".join(f", bool_or({src}) AS m_{out}" for out, src in flags.items())
    counts = "".join(f", CAST(count_if(m_{out}) AS INT) AS {out}" for out in flags)
    keys = "submission_id, file_id, organisation_id"
    return f"""
(SELECT {keys}, CAST(count(*) AS INT) AS number_of_subsidiaries{counts}
 FROM (SELECT {keys}, subsidiary_key{ors} FROM rs_members
       WHERE submission_type = 'Registration' AND {where} GROUP BY {keys}, subsidiary_key)
 GROUP BY {keys})"""


_LIST = ("organisation_name STRING DEFAULT NULL, organisation_reference STRING DEFAULT NULL, "
         "user_id BIGINT DEFAULT NULL, statuses STRING DEFAULT NULL, organisation_type STRING DEFAULT NULL, "
         "decisions_delta STRING DEFAULT NULL, years STRING DEFAULT NULL, periods STRING DEFAULT NULL")
_PACKAGING = (f"types STRING DEFAULT '{R.DEFAULT_PACKAGING_TYPES}', "
              f"materials STRING DEFAULT '{R.DEFAULT_PACKAGING_MATERIALS}'")


def _bodies() -> dict[str, tuple[str, str]]:
    """Function name -> (typed parameters, query)."""
    out: dict[str, tuple[str, str]] = {}
    out["pom_summaries"] = (_LIST, _summaries("pom_summaries", "Producer", schemas.POM_SUMMARY, "submitted_date", {
        "pom_file_name": "'pom_' || submission_id || '.csv'", "pom_blob_name": "file_id"}))
    out["registration_summaries"] = (_LIST, _summaries(
        "registration_summaries", "Registration", schemas.REGISTRATION_SUMMARY, "registration_date", {
            "company_details_file_id": "file_id", "company_details_blob_name": "file_id",
            "company_details_file_name": "'company_details_' || submission_id || '.csv'"}))
    fn = "approved_submissions"
    after = f"({fn}.approved_after - INTERVAL '{R.DECISION_DELAY.days}' DAY)"
    out[fn] = (f"approved_after TIMESTAMP_NTZ DEFAULT NULL, periods STRING DEFAULT NULL, {_PACKAGING}, "
               f"org_size STRING DEFAULT '{R.LARGE_ORGANISATION}'",
               _approved(fn, "", "CAST(NULL AS SMALLINT)", f"{_listed('submission_period', f'{fn}.periods')} "
                         f"AND {_optional('organisation_size', f'{fn}.org_size')} "
                         f"AND ({fn}.approved_after IS NULL OR submitted_at > {after} "
                         f"AND raw_date > {after} - {_SHIFT} - {_SLACK})"))
    fn = "approved_submissions_by_year"
    out[fn] = (f"period_year INT, {_PACKAGING}",
               _approved(fn, ", num_days_obligated", "num_days_obligated", _within_year(f"{fn}.period_year")))
    fn = "organisation_registration_summaries"
    out[fn] = ("organisation_names STRING DEFAULT NULL, organisation_references STRING DEFAULT NULL, "
               "years STRING DEFAULT NULL, statuses STRING DEFAULT NULL, resubmission_statuses STRING DEFAULT NULL, "
               "organisation_types STRING DEFAULT NULL, nation_id INT DEFAULT NULL, "
               "application_references STRING DEFAULT NULL", f"""
SELECT {_select(schemas.ORGANISATION_REGISTRATION_SUMMARY, _REGISTRATION)}
FROM (SELECT s.*, {_DECIDED} FROM {_history('Registration')}) s
     JOIN rs_organisations o ON s.organisation_id = o.organisation_id
WHERE {_listed('organisation_reference', f'{fn}.organisation_references')}
  AND {_listed('CAST(submission_year AS STRING)', f'{fn}.years')} AND {_listed('status', f'{fn}.statuses')}
  AND {_listed('CASE WHEN is_resubmission THEN status END', f'{fn}.resubmission_statuses')}
  AND {_listed('organisation_type', f'{fn}.organisation_types')}
  AND ({fn}.nation_id IS NULL OR o.nation_id = CASE WHEN {fn}.nation_id BETWEEN 1 AND 4 THEN {fn}.nation_id
       ELSE raise_error('nation id must be between 1 and 4') END)
  AND {_listed(_REGISTRATION['application_reference_number'], f'{fn}.application_references')}
  AND ({fn}.organisation_names IS NULL OR trim(replace({fn}.organisation_names, ',', ' ')) = ''
       OR exists(split({fn}.organisation_names, ','),
                 x -> trim(x) <> '' AND contains(lower(organisation_name), lower(trim(x)))))""")
    fn = "organisation_registration_detail"
    out[fn] = ("submission_id BIGINT", _detail(_one_with_history("Registration", fn)))
    out[f"{fn}s"] = ("", _detail(_history("Registration")))
    fn, scheme = "resubmission_pay_parameters", "compliance_scheme_id BIGINT DEFAULT NULL"
    for name, parameters, source in ((fn, f"submission_id BIGINT, {scheme}", _one_with_history("Producer", fn)),
                                     (f"{fn}_of_all", scheme, _history("Producer"))):
        out[name] = (parameters, f"""
SELECT * EXCEPT (compliance_scheme_id) FROM ({_pay_parameters(source)}) q
WHERE {_optional('q.compliance_scheme_id', f'{name}.compliance_scheme_id')}""")
    fn = "sync_available"
    key = f"coalesce({fn}.submission_id, {_file_key(f'{fn}.file_id')})"
    asked = (f"({fn}.submission_id IS NULL OR submission_id = {fn}.submission_id) "
             f"AND ({fn}.file_id IS NULL OR file_id = lower(trim({fn}.file_id)))")
    out[fn] = ("submission_id BIGINT DEFAULT NULL, file_id STRING DEFAULT NULL", f"""
SELECT count(*) > 0 AS is_synced
FROM (SELECT submission_id FROM rs_submissions WHERE submission_id = {key} AND {asked}) s
     JOIN (SELECT submission_id FROM rs_events WHERE submission_id = {key}) e ON s.submission_id = e.submission_id""")
    fn = "resubmission_synchronised"
    key = _file_key(f"{fn}.file_id")
    out[fn] = ("file_id STRING", f"""
SELECT coalesce(bool_or(trim(packaging_resubmission_reference_number) <> ''), false) AS is_synchronised
FROM (SELECT submission_id FROM rs_submissions
      WHERE submission_id = {key} AND file_id = lower(trim({fn}.file_id))) s
     JOIN (SELECT submission_id, packaging_resubmission_reference_number FROM rs_events
           WHERE submission_id = {key}) e ON s.submission_id = e.submission_id""")
    fn = "actual_submission_period"
    out[fn] = ("submission_id BIGINT, submission_period STRING", f"""
SELECT coalesce(max(CASE WHEN s.submission_period LIKE '%-H1' THEN 'January to June ' || submission_year
                         WHEN s.submission_period LIKE '%-H2' THEN 'January to December ' || submission_year END),
                url_decode({fn}.submission_period)) AS actual_submission_period
FROM (SELECT * FROM rs_submissions
      WHERE submission_type = 'Producer' AND submission_id = {fn}.submission_id) s""")
    between = "from_date TIMESTAMP_NTZ, to_date TIMESTAMP_NTZ"
    out["updated_producers"] = (between, _updated("updated_producers", schemas.UPDATED_PRODUCERS))
    out["updated_producers_v2"] = (between, _updated("updated_producers_v2", schemas.UPDATED_PRODUCERS_V2))
    fn = "registration_fee_details"
    flags = {"number_of_subsidiaries_being_online_market_place": "is_online_marketplace_line",
             "number_of_subsidiaries_being_closed_loop_recycling": "is_closed_loop_line"}
    key = f"submission_id = {_file_key(f'{fn}.file_id')} AND file_id = lower(trim({fn}.file_id))"
    out[fn] = ("file_id STRING", f"""
SELECT c.* EXCEPT (submission_id), {_SIZE.format(c='organisation_size')} AS organisation_size, is_online_marketplace,
       is_closed_loop_recycling, is_new_joiner, nation_id
FROM {_members(flags, key)} c JOIN rs_organisations o ON c.organisation_id = o.organisation_id""")
    fn = "paycal_organisations"
    out[fn] = ("relative_year INT", f"""
SELECT o.organisation_id, CAST(NULL AS STRING) AS subsidiary_id, organisation_name, trading_name, status_code,
       CAST(NULL AS STRING) AS error_code, joiner_date, leaver_date, obligation_status, num_days_obligated,
       CAST(o.organisation_id AS STRING) AS submitter_id, has_h1, has_h2
FROM (SELECT organisation_id, coalesce(bool_or(endswith(submission_period, '-H1')), false) AS has_h1,
             coalesce(bool_or(endswith(submission_period, '-H2')), false) AS has_h2
      FROM rs_submissions WHERE {_within_year(_year(f'{fn}.relative_year'))} GROUP BY organisation_id) f
     JOIN rs_organisations o ON f.organisation_id = o.organisation_id""")
    fn = "paycal_poms"
    halves = " ".join(f"WHEN '{code}' THEN '{text}'" for code, text in R.HALF_DESCRIPTIONS)
    out[fn] = ("relative_year INT", f"""
SELECT submission_period, CASE substring_index(submission_period, '-', -1) {halves} END || ' ' ||
         substring_index(submission_period, '-', 1) AS submission_period_description,
       organisation_id, CAST(subsidiary_key AS STRING) AS subsidiary_id, packaging_type, packaging_material,
       packaging_material_subtype, packaging_material_weight, packaging_class, packaging_activity,
       CAST(person_id AS STRING) AS submitter_id, ram_rag_rating
FROM rs_pom_lines WHERE submission_type = 'Producer' AND status = '{V.STATUS_ACCEPTED}'
  AND {_within_year(f"({_year(f'{fn}.relative_year')} - 1)")}""")
    out["last_sync_time"] = ("", "SELECT max(load_ts) AS last_sync_time FROM rs_events")
    return out


FUNCTIONS = tuple(_bodies())


def create_functions(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """Define the views and functions over ``sf_dir`` (or the session's stored layout); their names."""
    subs = V.submissions(spark, sf_dir, with_raw_date=True)
    views = {"submissions": subs, "organisations": V.organisations(spark, sf_dir),
             "persons": V.persons(spark, sf_dir), "regulators": V.regulator_nations(spark, sf_dir),
             "events": V.submission_events(spark, sf_dir), "pom_lines": V.pom_lines(spark, sf_dir, subs),
             "lines": V.line_members(spark, sf_dir), "members": V.pom_lines(spark, sf_dir, subs, with_part=False, spread=True)}
    for name, view in views.items():
        view.createOrReplaceTempView(f"rs_{name}")
    for name, (parameters, body) in _bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE RETURN {body}")
    return FUNCTIONS


def call(spark: SparkSession, sf_dir: str, query: str, args: dict | None = None) -> DataFrame:
    """``query`` over the functions of ``sf_dir``; ``args`` are named parameter markers (``:name``)."""
    create_functions(spark, sf_dir)
    return spark.sql(query, args=args)
