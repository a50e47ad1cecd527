"""Oracle SQL (DuckDB dialect) for every registered query.

The stand-in views are restated here in SQL; the query bodies use the plain
textbook forms (global windows, EXISTS, COUNT(DISTINCT), ORDER BY ... LIMIT)
that the Spark side deliberately avoids for scale, which makes them an
independent check of the DataFrame code.
"""

from __future__ import annotations

from regsight import schemas
from regsight.functions import scalar as P
from regsight.plans import catalog as C

GUID = "'00000000-0000-4000-8000-' || lpad(CAST({k} AS VARCHAR), 12, '0')"


def _period(ts: str) -> str:
    y = f"CAST(year({ts}) AS VARCHAR)"
    return (f"CASE WHEN year({ts}) <= 2024 THEN {y} || CASE WHEN month({ts}) <= 6 THEN '-P1' ELSE '-P4' END "
            f"ELSE {y} || CASE WHEN month({ts}) <= 6 THEN '-H1' ELSE '-H2' END END")


VIEWS = {
    "sub0": """SELECT o.*, o_orderdate + INTERVAL 29 YEAR AS submitted_at FROM orders o""",
    "sub": f"""SELECT o_orderkey AS submission_id,
      {GUID.format(k='o_orderkey')} AS file_id,
      o_custkey AS organisation_id,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Registration' ELSE 'Producer' END AS submission_type,
      CASE o_orderstatus WHEN 'F' THEN 'Accepted' WHEN 'O' THEN 'Pending' ELSE 'Rejected' END AS status,
      submitted_at,
      CAST(year(submitted_at) AS INTEGER) AS submission_year,
      {_period('submitted_at')} AS submission_period,
      o_orderpriority AS comments,
      o_orderkey % (SELECT count(*) FROM supplier) AS person_id
    FROM sub0""",
    "org": """SELECT c_custkey AS organisation_id, c_name AS organisation_name,
      c_name || ' Trading' AS trading_name,
      CAST(100000 + c_custkey AS VARCHAR) AS organisation_reference,
      CASE WHEN c_acctbal < 2000.0 THEN 'CS' ELSE 'DP' END AS organisation_type,
      CASE c_mktsegment WHEN 'MACHINERY' THEN 'L' WHEN 'AUTOMOBILE' THEN 's'
        WHEN 'FURNITURE' THEN 'x' WHEN 'HOUSEHOLD' THEN ' ' END AS organisation_size,
      CAST(1 + n_regionkey % 4 AS INTEGER) AS nation_id,
      CASE 1 + n_regionkey % 4 WHEN 1 THEN 'GB-ENG' WHEN 2 THEN 'GB-NIR' WHEN 3 THEN 'GB-SCT'
        WHEN 4 THEN 'GB-WLS' END AS nation_code,
      lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS companies_house_number,
      n_name AS country, r_name AS business_country,
      'PC' || CAST(c_nationkey AS VARCHAR) AS postcode,
      CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(1 + c_custkey % 365 AS SMALLINT) END AS num_days_obligated,
      c_acctbal >= 9000 AS is_online_marketplace,
      c_acctbal < 0 AS is_closed_loop_recycling,
      (c_acctbal >= 0 AND c_acctbal < 1000) AS is_new_joiner,
      CASE WHEN c_acctbal < 0 THEN 'Left' ELSE 'Active' END AS status_code,
      CASE WHEN c_acctbal < 0 THEN 'NotObligated' ELSE 'Obligated' END AS obligation_status,
      CASE WHEN c_acctbal >= 0 AND c_acctbal < 1000 THEN '2025-01-01' END AS joiner_date,
      CASE WHEN c_acctbal < 0 THEN '2025-12-31' END AS leaver_date
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
      LEFT JOIN region ON n_regionkey = r_regionkey""",
    "person": """SELECT s_suppkey AS person_id, s_name AS first_name,
      'Nation' || CAST(s_nationkey AS VARCHAR) AS last_name,
      lower(replace(s_name, '#', '.')) || '@example.com' AS email,
      '0' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS telephone,
      CASE WHEN s_acctbal < 0 THEN 'Basic User' ELSE 'Approved Person' END AS service_role
    FROM supplier""",
    "ev": f"""SELECT event_id AS submission_event_id, ts AS load_ts, user_id AS submission_id,
      {GUID.format(k='user_id')} AS file_id, event_type,
      CASE event_type WHEN 'purchase' THEN 'Accepted' WHEN 'error' THEN 'Rejected' END AS decision,
      props AS comments,
      event_type = 'error' AS is_resubmission_required,
      CASE WHEN event_type = 'signup' THEN 'PRN' || lpad(CAST(event_id AS VARCHAR), 8, '0')
           WHEN event_type = 'view' THEN '' END AS packaging_resubmission_reference_number
    FROM events""",
    "line": """SELECT s.*, l_suppkey AS subsidiary_key,
      CASE p_type WHEN 'PROMO' THEN 'HH' WHEN 'SMALL' THEN 'NH' WHEN 'MEDIUM' THEN 'PB'
        WHEN 'LARGE' THEN 'HDC' WHEN 'STANDARD' THEN 'NDC' WHEN 'ECONOMY' THEN 'CW' END AS packaging_type,
      (['AL', 'FC', 'GL', 'PC', 'PL', 'ST', 'WD', 'OT'])[1 + p_size % 8] AS packaging_material,
      CASE WHEN p_size % 8 = 4 THEN 'Rigid' END AS packaging_material_subtype,
      l_quantity AS packaging_material_weight,
      'P' || CAST(l_linenumber AS VARCHAR) AS packaging_class,
      CASE l_returnflag WHEN 'R' THEN 'Imported' WHEN 'A' THEN 'SoldAsEmpty' ELSE 'Brand' END AS packaging_activity,
      CASE WHEN l_tax >= 0.06 THEN 'RED' WHEN l_tax >= 0.03 THEN 'AMBER' ELSE 'GREEN' END AS ram_rag_rating,
      l_returnflag = 'R' AS is_online_marketplace_line,
      l_returnflag = 'A' AS is_closed_loop_line
    FROM lineitem JOIN sub s ON l_orderkey = s.submission_id JOIN part ON l_partkey = p_partkey""",
    "raw": f"""SELECT o_orderkey AS submission_id,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN ''
        ELSE upper({GUID.format(k='o_orderkey')}) END AS file_id_text,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN ''
        ELSE CAST(o_orderkey AS VARCHAR) END AS key_text,
      CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS status_int,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN ''
        ELSE strftime(submitted_at, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' END AS submitted_text,
      CASE WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 7 = 0 THEN ''
        WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(100000 + o_custkey AS VARCHAR) END AS reference_text,
      {GUID.format(k='o_orderkey')} || chr(13) || chr(10) AS file_id_crlf,
      CASE WHEN month(submitted_at) <= 6 THEN 'January+to%20June+' ELSE 'July+to%20December+' END
        || CAST(year(submitted_at) AS VARCHAR) AS period_label,
      CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS VARCHAR) END AS messy_int_text,
      CASE WHEN o_orderkey % 9 = 0 THEN 'invalid date string'
        ELSE strftime(submitted_at, '%Y-%m-%d') END AS messy_date_text
    FROM sub0""",
}
ORDER = ["sub0", "sub", "org", "person", "ev", "line", "raw"]


def _with(*extra: tuple[str, str]) -> str:
    ctes = [f"{n} AS ({VIEWS[n]})" for n in ORDER] + [f"{n} AS ({body})" for n, body in extra]
    return "WITH " + ",\n".join(ctes) + "\n"


def _hist(src: str) -> str:
    return f"""SELECT s.*,
      row_number() OVER w > 1 AS is_resubmission,
      lag(CASE WHEN status = 'Rejected' THEN comments END) OVER w AS previous_rejection_comments
    FROM {src} s WINDOW w AS (PARTITION BY organisation_id, submission_year
                              ORDER BY submitted_at, submission_id)"""


SIZE_SQL = ("CASE WHEN lower({c}) = 's' THEN 'Small' WHEN lower({c}) = 'l' THEN 'Large' "
            "ELSE 'Unknown' END")
TEXT_TS = "strftime({c}, '%Y-%m-%dT%H:%M:%S')"
SUBMITTER_TYPE = "CASE WHEN organisation_type = 'CS' THEN 'ComplianceScheme' ELSE 'DirectRegistrant' END"
LATEST_DECISION = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id
      ORDER BY load_ts DESC, submission_event_id DESC) AS rn FROM ev WHERE decision IS NOT NULL) WHERE rn = 1"""
HALF_DESC = ("CASE split_part(submission_period, '-', 2) WHEN 'H1' THEN 'January to June' "
             "WHEN 'H2' THEN 'July to December' WHEN 'P1' THEN 'January to June' "
             "WHEN 'P4' THEN 'July to December' END || ' ' || split_part(submission_period, '-', 1)")
TYPES_IN = "('HH', 'NH', 'PB', 'HDC', 'NDC')"
MATERIALS_IN = "('AL', 'FC', 'GL', 'PC', 'PL', 'ST', 'WD')"


def _sql_list(csv: str) -> str:
    return ", ".join(x if x.isdigit() else f"'{x}'" for x in csv.split(","))


def _page(page: int, size: int) -> str:
    return f"LIMIT {size} OFFSET {(page - 1) * size}"


def _delta(keys: int) -> str:
    """``catalog.decisions_request`` as rows, the last entry of a file only."""
    return f"""SELECT {GUID.format(k='k')} AS file_id,
      CASE WHEN k % 20 = 0 THEN 'Pending' WHEN k % 3 <> 0 THEN 'Rejected' ELSE 'Accepted' END AS decision,
      CASE WHEN k % 20 = 0 THEN 'again ' || k WHEN k % 5 <> 0 THEN 'delta ' || k END AS comments,
      CASE WHEN k % 20 <> 0 THEN k % 8 = 0 END AS is_resubmission_required
    FROM (SELECT unnest(range(4, {keys}, 4)) AS k)"""


def _request(kind: bool) -> str:
    names = f"""contains(lower(organisation_name), '{C.LIST_NAME}') AND decision2 IN ('Rejected', 'Pending')
      AND submission_year IN ({C.LIST_YEARS}) AND submission_period IN ({_sql_list(C.LIST_PERIODS)})
      AND nation_id = (SELECT 1 + n_regionkey % 4 FROM supplier JOIN nation ON s_nationkey = n_nationkey
                       WHERE s_suppkey = {C.LIST_USER})"""
    return names + (f" AND organisation_type = '{C.LIST_TYPE}'" if kind else "")


def q1(delta: str = "", where: str = "true", page: str = "") -> str:
    provided = {
        "file_id": "file_id", "is_resubmission_required": "irr",
        "submitted_date": TEXT_TS.format(c="submitted_at"), "submission_year": "submission_year",
        "actual_submission_period": "submission_period",
        "pom_file_name": "'pom_' || CAST(submission_id AS VARCHAR) || '.csv'",
        "pom_blob_name": "file_id", "submission_id": "submission_id",
        "organisation_id": "organisation_id",
        "compliance_scheme_id": "CASE WHEN organisation_type = 'CS' THEN organisation_id END",
        "organisation_name": "organisation_name", "organisation_reference": "organisation_reference",
        "organisation_type": "organisation_type", "producer_type": SIZE_SQL.format(c="organisation_size"),
        "user_id": "person_id", "first_name": "first_name", "last_name": "last_name",
        "email": "email", "telephone": "telephone", "service_role": "service_role",
        "submission_period": "submission_period", "decision": "decision2", "comments": "comments2",
        "is_resubmission": "is_resubmission",
        "previous_rejection_comments": "previous_rejection_comments", "nation_id": "nation_id",
    }
    return _with(
        ("hist", _hist("(SELECT * FROM sub WHERE submission_type = 'Producer')")),
        ("delta", delta or LATEST_DECISION),
        ("ov", """SELECT h.*, coalesce(d.decision, h.status) AS decision2,
                  coalesce(d.comments, h.comments) AS comments2, d.is_resubmission_required AS irr
                  FROM hist h LEFT JOIN delta d ON h.file_id = d.file_id"""),
        ("j", "SELECT * FROM ov JOIN org USING (organisation_id) LEFT JOIN person USING (person_id)"),
        ("r", f"SELECT {schemas.sql_select_list(schemas.POM_SUMMARY, provided)} FROM j WHERE {where}"),
    ) + f"""SELECT *, CAST(count(*) OVER () AS BIGINT) AS total_items, {1 if page else C.Q1_PAGE} AS current_page
    FROM r ORDER BY submitted_date DESC, submission_id {page or _page(C.Q1_PAGE, C.Q1_SIZE)}"""


def q2(delta: str = "", where: str = "true", page: str = "") -> str:
    provided = {
        "nation_id": "nation_id", "previous_rejection_comments": "previous_rejection_comments",
        "is_resubmission": "is_resubmission", "comments": "comments2", "decision": "decision2",
        "submission_period": "submission_period", "service_role": "service_role",
        "telephone": "telephone", "email": "email", "last_name": "last_name",
        "first_name": "first_name", "user_id": "person_id",
        "producer_type": SIZE_SQL.format(c="organisation_size"),
        "organisation_type": "organisation_type", "organisation_reference": "organisation_reference",
        "organisation_name": "organisation_name",
        "compliance_scheme_id": "CASE WHEN organisation_type = 'CS' THEN organisation_id END",
        "organisation_id": "organisation_id", "submission_id": "submission_id",
        "registration_date": TEXT_TS.format(c="submitted_at"),
        "company_details_blob_name": "file_id",
        "company_details_file_name": "'company_details_' || CAST(submission_id AS VARCHAR) || '.csv'",
        "company_details_file_id": "file_id", "postcode": "postcode", "country": "country",
        "companies_house_number": "companies_house_number",
    }
    return _with(
        ("hist", _hist("(SELECT * FROM sub WHERE submission_type = 'Registration')")),
        ("delta", delta or LATEST_DECISION),
        ("ov", """SELECT h.*, coalesce(d.decision, h.status) AS decision2,
                  coalesce(d.comments, h.comments) AS comments2
                  FROM hist h LEFT JOIN delta d ON h.file_id = d.file_id"""),
        ("j", "SELECT * FROM ov JOIN org USING (organisation_id) LEFT JOIN person USING (person_id)"),
        ("r", f"SELECT {schemas.sql_select_list(schemas.REGISTRATION_SUMMARY, provided)} FROM j WHERE {where}"),
    ) + f"""SELECT *, CAST(count(*) OVER () AS BIGINT) AS total_items, {1 if page else C.Q2_PAGE} AS current_page
    FROM r ORDER BY registration_date DESC, submission_id {page or _page(C.Q2_PAGE, C.Q2_SIZE)}"""


def _registration_provided() -> dict[str, str]:
    sub_text = TEXT_TS.format(c="submitted_at")
    decision_date = TEXT_TS.format(c="(submitted_at + INTERVAL 14 DAY)")
    return {
        "submission_id": "submission_id", "organisation_id": "organisation_id",
        "organisation_type": "organisation_type",
        "registration_journey": ("CASE WHEN organisation_type = 'CS' THEN 'CsoLargeProducer' "
                                 "WHEN organisation_size = 'L' THEN 'DirectLargeProducer' "
                                 "ELSE 'DirectSmallProducer' END"),
        "organisation_name": "organisation_name", "organisation_reference": "organisation_reference",
        "submission_status": "status",
        "status_pending_date": f"CASE WHEN status = 'Pending' THEN {sub_text} END",
        "application_reference_number": "'APP' || lpad(CAST(submission_id AS VARCHAR), 8, '0')",
        "registration_reference_number": ("CASE WHEN status = 'Accepted' THEN 'R' || "
                                          "CAST(submission_year AS VARCHAR) || "
                                          "lpad(CAST(organisation_id AS VARCHAR), 6, '0') END"),
        "relevant_year": "submission_year + 1", "submitted_date_time": sub_text,
        "nation_id": "nation_id",
        "regulator_decision_date": f"CASE WHEN status <> 'Pending' THEN {decision_date} END",
        "is_resubmission": "is_resubmission",
        "resubmission_status": "CASE WHEN is_resubmission THEN status END",
        "resubmission_date": f"CASE WHEN is_resubmission THEN {sub_text} END",
        "registration_date": f"CASE WHEN status = 'Accepted' THEN {decision_date} END",
    }


def q5() -> str:
    provided = _registration_provided()
    return _with(
        ("hist", _hist("(SELECT * FROM sub WHERE submission_type = 'Registration')")),
        ("j", f"""SELECT * FROM hist JOIN org USING (organisation_id) LEFT JOIN person USING (person_id)
                 WHERE submission_year IN ({_sql_list(C.Q5_YEARS)})
                   AND status IN ({_sql_list(C.Q5_STATUSES)})"""),
        ("r", f"SELECT {schemas.sql_select_list(schemas.ORGANISATION_REGISTRATION_SUMMARY, provided)} FROM j"),
        ("pg", f"""SELECT count(*) AS total,
                  greatest(1, least({C.Q5_PAGE}, CAST(ceil(count(*) / {C.Q5_SIZE}.0) AS INTEGER))) AS cur
                  FROM r"""),
        ("ranked", "SELECT r.*, row_number() OVER (ORDER BY submitted_date_time DESC, submission_id) AS rn FROM r"),
    ) + f"""SELECT ranked.* EXCLUDE (rn), CAST(pg.total AS BIGINT) AS total_items,
      CAST(pg.cur AS INTEGER) AS current_page
    FROM ranked, pg WHERE rn > (pg.cur - 1) * {C.Q5_SIZE} AND rn <= pg.cur * {C.Q5_SIZE}"""


def q6() -> str:
    provided = _registration_provided()
    provided.update({
        "is_late_submission": "false", "submission_period": "submission_period",
        "is_compliance_scheme": "organisation_type = 'CS'",
        "organisation_size": "organisation_size", "nation_code": "nation_code",
        "regulator_comment": "CASE WHEN status = 'Rejected' THEN comments END",
        "companies_house_number": "companies_house_number", "country": "country",
        "postcode": "postcode", "submitted_user_id": "person_id", "first_name": "first_name",
        "last_name": "last_name", "email": "email", "telephone": "telephone",
        "service_role": "service_role", "is_online_market_place": "is_online_marketplace",
        "company_details_file_id": "file_id",
        "company_details_file_name": "'company_details_' || CAST(submission_id AS VARCHAR) || '.csv'",
        "company_details_blob_name": "file_id",
        "number_of_subsidiaries": "number_of_subsidiaries",
        "number_of_online_subsidiaries": "number_of_online_subsidiaries",
        "number_of_subsidiaries_closed_loop_recycling": "number_of_subsidiaries_closed_loop_recycling",
    })
    return _with(
        ("hist", _hist("(SELECT * FROM sub WHERE submission_type = 'Registration')")),
        ("c", _fee_counts("number_of_online_subsidiaries",
                          "number_of_subsidiaries_closed_loop_recycling")),
        ("j", """SELECT * FROM hist JOIN org USING (organisation_id) LEFT JOIN person USING (person_id)
                 LEFT JOIN c USING (file_id, organisation_id)"""),
    ) + f"SELECT {schemas.sql_select_list(schemas.ORGANISATION_REGISTRATION_DETAIL, provided)} FROM j"


def _approved(where: str, days: str) -> str:
    return _with() + f"""SELECT submission_period, packaging_material, organisation_id,
      person_id AS submitter_id, {SUBMITTER_TYPE} AS submitter_type,
      CAST(trunc(sum(CAST(packaging_material_weight AS DECIMAL(18, 2)))) AS BIGINT) AS packaging_material_weight,
      {days} AS number_of_days_obligated
    FROM line JOIN org USING (organisation_id)
    WHERE submission_type = 'Producer' AND status = 'Accepted' {where}
    GROUP BY ALL"""


def q3() -> str:
    periods = P.periods_for_year(P.derive_period_year(C.Q3_AS_OF))
    return _approved(f"""AND submission_period IN ({_sql_list(periods)})
      AND submitted_at + INTERVAL 14 DAY > TIMESTAMP '{C.Q3_APPROVED_AFTER}' AND organisation_size = 'L'
      AND packaging_type IN """ + TYPES_IN + " AND packaging_material IN " + MATERIALS_IN,
                     "CAST(NULL AS SMALLINT)")


def q4() -> str:
    year = P.derive_period_year(C.Q4_AS_OF)
    return _approved(f"AND submission_year = {year} AND packaging_type IN " + TYPES_IN
                     + " AND packaging_material IN " + MATERIALS_IN, "num_days_obligated")


def q7() -> str:
    return _with(
        ("req", "SELECT DISTINCT submission_id FROM ev"),
        ("hist", _hist("(SELECT * FROM sub WHERE submission_type = 'Producer')")),
        ("s", """SELECT h.*, o.nation_code FROM hist h JOIN org o USING (organisation_id)
                 WHERE h.submission_id IN (SELECT submission_id FROM req)"""),
        ("params", """SELECT s.submission_id, bool_or(s.is_resubmission) AS is_resubmission,
                  max(CASE WHEN s.is_resubmission THEN s.submitted_at END) AS resubmission_date,
                  CAST(count(DISTINCT l_suppkey) AS INTEGER) AS member_count,
                  max(s.nation_code) AS nation_code
                  FROM s LEFT JOIN lineitem ON l_orderkey = s.submission_id
                  GROUP BY s.submission_id"""),
        ("refs", """SELECT submission_id, packaging_resubmission_reference_number AS reference FROM (
                  SELECT *, row_number() OVER (PARTITION BY submission_id
                    ORDER BY load_ts DESC, submission_event_id DESC) AS rn
                  FROM ev WHERE packaging_resubmission_reference_number IS NOT NULL) WHERE rn = 1"""),
    ) + """SELECT r.submission_id, p.is_resubmission, p.resubmission_date, p.member_count,
      f.reference, p.nation_code, true AS reference_field_available,
      CASE WHEN p.submission_id IS NULL THEN 'no_content'
           WHEN f.reference IS NULL OR trim(f.reference) = '' THEN 'reference_missing'
           ELSE 'ready' END AS outcome
    FROM req r LEFT JOIN params p ON r.submission_id = p.submission_id
      LEFT JOIN refs f ON p.submission_id = f.submission_id"""


def q8() -> str:
    return _with() + """SELECT submission_id, file_id,
      EXISTS (SELECT 1 FROM ev WHERE ev.submission_id = sub.submission_id) AS is_synced FROM sub"""


def q9() -> str:
    return _with() + """SELECT file_id,
      (file_id IN (SELECT file_id FROM ev)) AND (file_id IN (SELECT file_id FROM ev
        WHERE packaging_resubmission_reference_number IS NOT NULL
          AND trim(packaging_resubmission_reference_number) <> '')) AS is_synchronised
    FROM sub"""


def q10() -> str:
    return _with(
        ("req", """SELECT replace(replace(file_id_crlf, chr(13), ''), chr(10), '') AS file_id,
                   url_decode(replace(period_label, '+', '%20')) AS requested_period FROM raw"""),
        ("stored", """SELECT file_id, CASE
                   WHEN submission_period LIKE '%-H1' THEN 'January to June ' || CAST(submission_year AS VARCHAR)
                   WHEN submission_period LIKE '%-H2' THEN 'January to December ' || CAST(submission_year AS VARCHAR)
                   END AS stored_period FROM sub WHERE submission_type = 'Producer'"""),
    ) + """SELECT r.file_id, r.requested_period,
      coalesce(s.stored_period, r.requested_period) AS actual_submission_period
    FROM req r LEFT JOIN stored s ON r.file_id = s.file_id"""


def _updated(schema, extra: dict[str, str]) -> str:
    provided = {
        "organisation_name": "organisation_name", "trading_name": "trading_name",
        "organisation_type": "organisation_type",
        "companies_house_number": "companies_house_number",
        "country": "country", "postcode": "postcode",
        "peprid": "'PRD' || lpad(CAST(organisation_id AS VARCHAR), 8, '0')",
        "status": "status", "business_country": "business_country",
        "updated_date_time": "submitted_at",
    }
    provided.update(extra)
    return _with(
        ("w", f"""SELECT * FROM sub WHERE submitted_at BETWEEN TIMESTAMP '{C.Q11_FROM}'
                 AND TIMESTAMP '{C.Q11_TO}'"""),
        ("latest", """SELECT organisation_id, submitted_at, status FROM (SELECT *, row_number() OVER (
                 PARTITION BY organisation_id ORDER BY submitted_at DESC, submission_id DESC) AS rn
                 FROM w) WHERE rn = 1"""),
    ) + f"SELECT {schemas.sql_select_list(schema, provided)} FROM latest JOIN org USING (organisation_id)"


def q11() -> str:
    return _updated(schemas.UPDATED_PRODUCERS, {"organisation_id": "CAST(organisation_id AS VARCHAR)"})


def q12() -> str:
    return _updated(schemas.UPDATED_PRODUCERS_V2,
                    {"registration_year": "CAST(year(submitted_at) AS VARCHAR)"})


def _fee_counts(online: str, closed: str) -> str:
    return f"""SELECT file_id, organisation_id,
      CAST(count(DISTINCT subsidiary_key) AS INTEGER) AS number_of_subsidiaries,
      CAST(count(DISTINCT CASE WHEN is_online_marketplace_line THEN subsidiary_key END) AS INTEGER) AS {online},
      CAST(count(DISTINCT CASE WHEN is_closed_loop_line THEN subsidiary_key END) AS INTEGER) AS {closed}
    FROM (SELECT file_id, organisation_id, l_suppkey AS subsidiary_key, l_returnflag = 'R' AS is_online_marketplace_line,
        l_returnflag = 'A' AS is_closed_loop_line
      FROM lineitem JOIN sub ON l_orderkey = submission_id WHERE submission_type = 'Registration')
    GROUP BY file_id, organisation_id"""


def q13() -> str:
    return _with(("c", _fee_counts("number_of_subsidiaries_being_online_market_place",
                                   "number_of_subsidiaries_being_closed_loop_recycling"))) + f"""
    SELECT c.*, {SIZE_SQL.format(c='organisation_size')} AS organisation_size,
      is_online_marketplace, is_closed_loop_recycling, is_new_joiner, nation_id
    FROM c JOIN org USING (organisation_id)"""


def _org_extract(flags_from: str, join: str) -> str:
    return f"""SELECT o.organisation_id, CAST(NULL AS VARCHAR) AS subsidiary_id, organisation_name,
      trading_name, status_code, CAST(NULL AS VARCHAR) AS error_code, joiner_date, leaver_date,
      obligation_status, num_days_obligated, CAST(o.organisation_id AS VARCHAR) AS submitter_id,
      coalesce(f.has_h1, false) AS has_h1, coalesce(f.has_h2, false) AS has_h2
    FROM {flags_from} {join}"""


def _flags(where: str, keys: str) -> str:
    return f"""SELECT {keys}, bool_or(submission_period LIKE '%-H1') AS has_h1,
      bool_or(submission_period LIKE '%-H2') AS has_h2 FROM sub {where} GROUP BY {keys}"""


def q14() -> str:
    return _with(("f", _flags(f"WHERE submission_year = {C.RELATIVE_YEAR}",
                              "organisation_id, submission_year"))) + \
        _org_extract("f", "JOIN org o ON f.organisation_id = o.organisation_id")


def _pom_extract(where: str) -> str:
    return f"""SELECT submission_period, {HALF_DESC} AS submission_period_description,
      organisation_id, CAST(subsidiary_key AS VARCHAR) AS subsidiary_id, packaging_type,
      packaging_material, packaging_material_subtype, packaging_material_weight, packaging_class,
      packaging_activity, CAST(person_id AS VARCHAR) AS submitter_id, ram_rag_rating
    FROM line {where}"""


def q15() -> str:
    return _with() + _pom_extract(f"""WHERE submission_type = 'Producer' AND status = 'Accepted'
      AND submission_year = {C.RELATIVE_YEAR - 1}""")


def q16() -> str:
    return "SELECT max(ts) AS last_sync_time FROM events"


def s4() -> str:
    def field(key: str, expr: str, kind: str) -> str:
        val = {"str": f"to_json({expr})", "num": f"CAST({expr} AS VARCHAR)",
               "bool": f"CASE WHEN {expr} THEN 'true' ELSE 'false' END"}[kind]
        return f"CASE WHEN {expr} IS NOT NULL THEN '\"{key}\":' || {val} END"
    fields = [("organisationId", "organisation_id", "num"), ("subsidiaryId", "subsidiary_id", "str"),
              ("organisationName", "organisation_name", "str"), ("tradingName", "trading_name", "str"),
              ("statusCode", "status_code", "str"), ("errorCode", "error_code", "str"),
              ("joinerDate", "joiner_date", "str"), ("leaverDate", "leaver_date", "str"),
              ("obligationStatus", "obligation_status", "str"),
              ("numDaysObligated", "num_days_obligated", "num"),
              ("submitterId", "submitter_id", "str"), ("hasH1", "has_h1", "bool"),
              ("hasH2", "has_h2", "bool")]
    body = ",\n      ".join(field(*f) for f in fields)
    return f"WITH x AS ({q14()})\nSELECT '{{' || concat_ws(',',\n      {body}) || '}}' AS line FROM x"


def s5() -> str:
    return f"WITH x AS ({q15()}) SELECT count(*) AS records, 'completed' AS status FROM x"


ORACLE: dict[str, str] = {
    "pom_summaries": q1(), "registration_summaries": q2(), "approved_submissions": q3(),
    "approved_submissions_by_year": q4(), "organisation_registration_summaries": q5(),
    "organisation_registration_detail": q6(), "resubmission_pay_parameters": q7(),
    "sync_available": q8(), "resubmission_synchronised": q9(), "actual_submission_period": q10(),
    "updated_producers": q11(), "updated_producers_v2": q12(), "registration_fee_details": q13(),
    "paycal_organisations": q14(), "paycal_poms": q15(), "last_sync_time": q16(),
    # scans, sources, sinks
    "scan_events": "SELECT event_id, ts AS last_sync_time, user_id, event_type, value, props FROM events",
    "align_schema": _with() + """SELECT submission_id, file_id_text, TRY_CAST(key_text AS INTEGER) AS key_text,
      status_int, CAST(NULL AS VARCHAR) AS comments, false AS is_valid FROM raw""",
    "evolve_schema": _with() + """SELECT submission_event_id, load_ts, submission_id, decision,
      CAST(NULL AS BOOLEAN) AS is_resubmission_required, CAST(NULL AS VARCHAR) AS comments,
      CAST(NULL AS VARCHAR) AS packaging_resubmission_reference_number FROM ev""",
    "ndjson_export": s4(),
    "export_summary": s5(),
    # normalisation
    "norm_guid": _with() + """SELECT submission_id, CASE WHEN file_id_text IS NULL OR file_id_text = ''
      THEN NULL ELSE lower(trim(file_id_text)) END AS file_id FROM raw""",
    "norm_int": _with() + "SELECT submission_id, CAST(NULLIF(key_text, '') AS INTEGER) AS key_int FROM raw",
    "norm_bool": _with() + """SELECT submission_id, status_int > 0 AS is_accepted,
      CASE WHEN status_int > 0 THEN 1 ELSE 0 END AS status_flag FROM raw""",
    "norm_timestamp": _with() + """SELECT submission_id,
      CAST(substr(NULLIF(submitted_text, ''), 1, 26) AS TIMESTAMP) AS submitted_at FROM raw""",
    "norm_reference": _with() + """SELECT submission_id,
      CASE WHEN reference_text IS NULL OR trim(reference_text) = '' THEN NULL
           ELSE CAST(reference_text AS INTEGER) END AS reference,
      CASE WHEN reference_text IS NULL OR trim(reference_text) = '' THEN NULL
           ELSE CAST(CAST(reference_text AS INTEGER) AS VARCHAR) END AS reference_json FROM raw""",
    "lenient_cells": _with() + """SELECT
      count(*) FILTER (WHERE messy_int_text IS NOT NULL AND messy_int_text <> ''
                       AND TRY_CAST(messy_int_text AS INTEGER) IS NULL) AS messy_int_text_rejects,
      count(*) FILTER (WHERE messy_date_text IS NOT NULL AND messy_date_text <> ''
                       AND TRY_CAST(messy_date_text AS TIMESTAMP) IS NULL) AS messy_date_text_rejects
    FROM raw""",
    "sanitise_id": _with() + """SELECT submission_id,
      replace(replace(file_id_crlf, chr(13), ''), chr(10), '') AS file_id FROM raw""",
    "decode_period": _with() + """SELECT submission_id,
      url_decode(replace(period_label, '+', '%20')) AS period FROM raw""",
    "parse_utc_date": _with() + """SELECT submission_id, TRY_CAST(messy_date_text AS TIMESTAMP) AS approved_after,
      CASE WHEN TRY_CAST(messy_date_text AS TIMESTAMP) IS NULL
        THEN 'Invalid datetime provided; please make sure it''s a valid UTC datetime' END AS error
    FROM raw""",
    # filters
    "filter_csv": _with() + """SELECT submission_id, submission_period FROM sub
      WHERE submission_type = 'Producer' AND submission_period IN ('2025-H1', '2026-H2')""",
    "filter_optional_eq": _with() + f"SELECT organisation_id, nation_id FROM org WHERE nation_id = {C.F2_NATION}",
    "filter_name": _with() + f"""SELECT organisation_id, organisation_name FROM org
      WHERE contains(lower(organisation_name), '{C.F3_NAME}')""",
    "filter_approved_after": _with() + f"""SELECT submission_id, submitted_at FROM sub
      WHERE submitted_at > TIMESTAMP '{C.F4_AFTER}'""",
    "filter_delta_window": _with() + f"""SELECT submission_id, submitted_at FROM sub
      WHERE submitted_at >= TIMESTAMP '{C.F5_FROM}' AND submitted_at <= TIMESTAMP '{C.F5_TO}'""",
    "filter_relative_year": _with() + f"""SELECT submission_id, submission_year FROM sub
      WHERE submission_type = 'Producer' AND submission_year = {C.RELATIVE_YEAR - 1}""",
    "filter_key": _with() + """SELECT submission_id, file_id FROM sub
      WHERE submission_id IN (SELECT submission_id FROM ev)""",
    # projections
    "project_organisation": _with(("f", _flags("", "organisation_id"))) +
        _org_extract("org o", "LEFT JOIN f ON f.organisation_id = o.organisation_id"),
    "project_pom": _with() + _pom_extract(""),
    "map_org_size": _with() + f"""SELECT organisation_id, organisation_size AS size_code,
      {SIZE_SQL.format(c='organisation_size')} AS organisation_size FROM org""",
    "strip_bookkeeping": _with() + "SELECT submission_id, status FROM sub WHERE submission_type = 'Registration'",
    "derive_period_year": _with(("y", """SELECT submission_id,
        CASE WHEN CAST(submitted_at AS DATE) >= make_date(year(submitted_at), 2, 1)
             THEN year(submitted_at) - 1 ELSE year(submitted_at) - 2 END AS py FROM sub""")) + """
      SELECT submission_id, CAST(py AS INTEGER) AS period_year,
        CASE WHEN py <= 2024 THEN CAST(py AS VARCHAR) || '-P1,' || CAST(py AS VARCHAR) || '-P4'
             ELSE CAST(py AS VARCHAR) || '-H1,' || CAST(py AS VARCHAR) || '-H2' END AS periods FROM y""",
    "classify_readiness": f"SELECT submission_id, outcome FROM ({q7()})",
    "fold_flag": _with() + """SELECT submission_id,
      coalesce(submission_id IN (SELECT submission_id FROM ev), false) AS is_synced FROM sub""",
    "decode_decisions": _with() + """SELECT submission_event_id, file_id, decision, comments,
      is_resubmission_required FROM ev WHERE event_type NOT IN ('view', 'click')""",
    # joins
    "overlay_decisions": _with(("delta", LATEST_DECISION)) + """SELECT s.submission_id, s.file_id,
      coalesce(d.decision, s.status) AS decision, coalesce(d.comments, s.comments) AS comments
    FROM sub s LEFT JOIN delta d ON s.file_id = d.file_id WHERE s.submission_type = 'Producer'""",
    "enrich_submissions": _with() + """SELECT submission_id, organisation_name, nation_id, email
      FROM sub JOIN org USING (organisation_id) LEFT JOIN person USING (person_id)""",
    "exists_synced": _with() + """SELECT submission_id,
      EXISTS (SELECT 1 FROM ev WHERE ev.submission_id = sub.submission_id) AS is_synced FROM sub""",
    "exists_both": _with() + """SELECT file_id, (file_id IN (SELECT file_id FROM ev))
      AND (file_id IN (SELECT file_id FROM ev WHERE decision = 'Rejected')) AS is_rejected
      FROM sub WHERE submission_type = 'Registration'""",
    "lookup_period": _with() + """SELECT submission_id, organisation_id, submission_period,
      coalesce(CASE WHEN organisation_size IS NOT NULL THEN organisation_name END, submission_period) AS label
      FROM sub LEFT JOIN org USING (organisation_id)""",
    # aggregations
    "max_sync_time": "SELECT max(ts) AS last_sync_time FROM events",
    "approved_weights": _approved("", "CAST(NULL AS SMALLINT)"),
    "approved_weights_by_year": _approved("", "num_days_obligated"),
    "fee_counts": _with() + _fee_counts("number_of_online_subsidiaries",
                                        "number_of_closed_loop_subsidiaries"),
    "resubmission_parameters": _with(
        ("hist", _hist("(SELECT * FROM sub WHERE submission_type = 'Producer')")),
    ) + """SELECT h.submission_id, bool_or(h.is_resubmission) AS is_resubmission,
      max(CASE WHEN h.is_resubmission THEN h.submitted_at END) AS resubmission_date,
      CAST(count(DISTINCT l_suppkey) AS INTEGER) AS member_count, max(o.nation_code) AS nation_code
    FROM hist h JOIN org o ON h.organisation_id = o.organisation_id
      LEFT JOIN lineitem ON l_orderkey = h.submission_id
    GROUP BY h.submission_id""",
    "half_year_flags": _with() + _flags("", "organisation_id, submission_year"),
    # windows, sort, limit
    "total_items": _with() + """SELECT submission_id, CAST(count(*) OVER () AS BIGINT) AS total_items
      FROM sub WHERE submission_type = 'Producer'""",
    "resubmission_history": _with(("hist", _hist("sub"))) + """SELECT submission_id, is_resubmission,
      previous_rejection_comments FROM hist""",
    "page_plain": _with(("r", "SELECT submission_id, submitted_at, status FROM sub WHERE submission_type = 'Producer'")) +
        f"""SELECT *, CAST(count(*) OVER () AS BIGINT) AS total_items, {C.L1_PAGE} AS current_page
      FROM r ORDER BY submitted_at DESC, submission_id {_page(C.L1_PAGE, C.L1_SIZE)}""",
    "page_clamped": _with(
        ("r", "SELECT submission_id, submitted_at FROM sub WHERE submission_type = 'Registration'"),
        ("pg", f"""SELECT count(*) AS total, greatest(1, least({C.L2_PAGE},
                  CAST(ceil(count(*) / {C.L2_SIZE}.0) AS INTEGER))) AS cur FROM r"""),
        ("ranked", "SELECT r.*, row_number() OVER (ORDER BY submitted_at DESC, submission_id) AS rn FROM r"),
    ) + f"""SELECT ranked.* EXCLUDE (rn), CAST(pg.total AS BIGINT) AS total_items,
      CAST(pg.cur AS INTEGER) AS current_page
    FROM ranked, pg WHERE rn > (pg.cur - 1) * {C.L2_SIZE} AND rn <= pg.cur * {C.L2_SIZE}""",
    "first_or_none": _with() + """SELECT organisation_id, submission_id, submitted_at FROM (
      SELECT *, row_number() OVER (PARTITION BY organisation_id ORDER BY submitted_at, submission_id) AS rn
      FROM sub) WHERE rn = 1""",
}

# the delivery of ``standin.organisations_delivered``
_DELIVERED = """SELECT submission_id, organisation_id, organisation_name, nation_id, is_online_marketplace,
      organisation_id % 10 = 0 AS bad_nation, organisation_id % 15 = 0 AS bad_flag
    FROM sub JOIN org USING (organisation_id) WHERE submission_type = 'Registration'"""
_FIRST_PAGE = _page(1, C.LIST_SIZE)

ORACLE |= {
    "pom_summaries_request": q1(_delta(C.LIST_DELTA_KEYS), _request(True), _FIRST_PAGE),
    "registration_summaries_request": q2(_delta(C.LIST_DELTA_KEYS), _request(False), _FIRST_PAGE),
    "lenient_report": _with(("d", _DELIVERED)) + """SELECT count(*) AS rows,
      count(*) FILTER (WHERE bad_nation) AS nation_id_rejects,
      count(*) FILTER (WHERE bad_flag) AS is_online_market_place_rejects FROM d""",
    "reject_rows": _with(("d", _DELIVERED)) + """SELECT submission_id, 'nation_id' AS column_name, 'n/a' AS value
      FROM d WHERE bad_nation UNION ALL
      SELECT submission_id, 'is_online_market_place', 'perhaps' FROM d WHERE bad_flag""",
    "lenient_defaults": _with(("d", _DELIVERED)) + """SELECT submission_id,
      CASE WHEN bad_nation OR organisation_id % 17 = 0 THEN 0 ELSE nation_id END AS nation_id,
      is_online_marketplace AND NOT bad_flag AS is_online_market_place, organisation_name FROM d""",
    "export_resumed": f"""WITH x AS ({q15()}) SELECT count(*) AS records, 'aborted' AS first_status,
      'completed' AS status, true AS whole FROM x""",
}
ORACLE |= {f"sql_{name}": ORACLE[name] for name in (
    "approved_submissions", "approved_submissions_by_year", "organisation_registration_detail",
    "resubmission_pay_parameters", "sync_available", "resubmission_synchronised", "updated_producers",
    "updated_producers_v2", "registration_fee_details", "paycal_organisations", "paycal_poms", "last_sync_time")}
ORACLE |= {
    "sql_pom_summaries": ORACLE["pom_summaries_request"],
    "sql_registration_summaries": ORACLE["registration_summaries_request"],
    "sql_organisation_registration_summaries": _with(
        ("hist", _hist("(SELECT * FROM sub WHERE submission_type = 'Registration')")),
        ("j", f"""SELECT * FROM hist JOIN org USING (organisation_id)
                  WHERE submission_year IN ({_sql_list(C.Q5_YEARS)}) AND status IN ({_sql_list(C.Q5_STATUSES)})"""),
    ) + f"SELECT {schemas.sql_select_list(schemas.ORGANISATION_REGISTRATION_SUMMARY, _registration_provided())} FROM j",
    "sql_actual_submission_period": _with() + """SELECT submission_id, CASE
      WHEN submission_type = 'Producer' AND submission_period LIKE '%-H1' THEN 'January to June ' || submission_year
      WHEN submission_type = 'Producer' AND submission_period LIKE '%-H2' THEN 'January to December ' || submission_year
      ELSE 'January to June' END AS actual_submission_period FROM sub""",
}

# the vintages of ``standin.organisation_vintage``
_VINTAGES = (
    ("old", """SELECT *, CASE WHEN organisation_id % 5 = 0 THEN NULL ELSE 'County' END AS county
      FROM org WHERE organisation_id % 13 <> 0"""),
    ("new", """SELECT * REPLACE (CASE WHEN organisation_id % 7 = 0 THEN postcode || 'A' ELSE postcode END AS postcode),
      CASE WHEN organisation_id % 5 = 0 THEN '' ELSE 'County' END AS county
      FROM org WHERE organisation_id % 11 <> 0 OR organisation_id % 13 = 0"""),
    ("ch", """SELECT organisation_id, 'inserted' AS change FROM new
        WHERE organisation_id NOT IN (SELECT organisation_id FROM old)
      UNION ALL SELECT organisation_id, 'removed' FROM old
        WHERE organisation_id NOT IN (SELECT organisation_id FROM new)
      UNION ALL SELECT o.organisation_id, 'updated' FROM old o JOIN new n USING (organisation_id)
        WHERE o.postcode IS DISTINCT FROM n.postcode OR o.county IS DISTINCT FROM n.county"""))
_CHANGED = {f.name: f.name for f in schemas.UPDATED_PRODUCERS.fields if f.name in (
    "organisation_name", "trading_name", "organisation_type", "companies_house_number", "county", "country",
    "postcode", "business_country", "organisation_id")} | {
    "status": "change", "updated_date_time": f"TIMESTAMP '{C.Q11_TO}'",
    "peprid": "'PRD' || lpad(CAST(organisation_id AS VARCHAR), 8, '0')"}
ORACLE |= {
    "organisation_changes": _with(*_VINTAGES) + "SELECT * FROM ch",
    "changed_producers": _with(*_VINTAGES, ("shown", """SELECT * FROM new UNION ALL BY NAME
        SELECT * FROM old WHERE organisation_id NOT IN (SELECT organisation_id FROM new)""")) + f"""
      SELECT {schemas.sql_select_list(schemas.UPDATED_PRODUCERS, _CHANGED)}
      FROM shown JOIN ch USING (organisation_id)""",
    "filter_name_indexed": _with() + f"""SELECT organisation_id, organisation_name FROM org
      WHERE contains(lower(organisation_name), lower('{C.INDEX_NAME}'))""",
    "page_from_directory": _with(
        ("r", """SELECT submission_id, submission_year,
                 CASE WHEN submission_period LIKE '%-H%' THEN split_part(submission_period, '-', 2) END AS half
                 FROM sub WHERE submission_type = 'Registration'"""),
        ("pg", f"""SELECT count(*) AS total, greatest(1, least({C.L2_PAGE},
                  CAST(ceil(count(*) / {C.DIRECTORY_SIZE}.0) AS INTEGER))) AS cur FROM r"""),
        ("ranked", """SELECT r.*, row_number() OVER (ORDER BY half ASC NULLS LAST, submission_year DESC,
                      submission_id) AS rn FROM r"""),
    ) + f"""SELECT ranked.* EXCLUDE (rn), CAST(pg.total AS BIGINT) AS total_items,
      CAST(pg.cur AS INTEGER) AS current_page
    FROM ranked, pg WHERE rn > (pg.cur - 1) * {C.DIRECTORY_SIZE} AND rn <= pg.cur * {C.DIRECTORY_SIZE}""",
}
