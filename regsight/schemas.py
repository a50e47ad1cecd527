"""Result schemas of the reports (column names in snake_case).

Non-nullable fields are the reference model's value types (bool, int,
short); ``align_schema`` gives them the type default when the source has no
value. Ids are the warehouse's numeric keys (``bigint``); file ids are GUID
text.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, SH, B, TS, D = (T.StringType(), T.IntegerType(), T.LongType(), T.ShortType(),
                         T.BooleanType(), T.TimestampNTZType(), T.DoubleType())


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


POM_SUMMARY = _schema(
    ("file_id", S, True), ("is_resubmission_required", B, False), ("submitted_date", S, True),
    ("submission_year", SH, False), ("submission_code", S, True),
    ("actual_submission_period", S, True), ("pom_file_name", S, True),
    ("pom_blob_name", S, True), ("submission_id", L, True), ("organisation_id", L, True),
    ("compliance_scheme_id", L, True), ("organisation_name", S, True),
    ("organisation_reference", I, True), ("organisation_type", S, True),
    ("producer_type", S, True), ("user_id", L, True), ("first_name", S, True),
    ("last_name", S, True), ("email", S, True), ("telephone", S, True),
    ("service_role", S, True), ("submission_period", S, True), ("decision", S, True),
    ("comments", S, True), ("is_resubmission", B, False),
    ("previous_rejection_comments", S, True), ("nation_id", SH, False),
)

REGISTRATION_SUMMARY = _schema(
    ("nation_id", I, False), ("previous_rejection_comments", S, True),
    ("is_resubmission", B, False), ("comments", S, True), ("decision", S, True),
    ("submission_period", S, True), ("service_role", S, True), ("telephone", S, True),
    ("email", S, True), ("last_name", S, True), ("first_name", S, True), ("user_id", L, True),
    ("producer_type", S, True), ("organisation_type", S, True),
    ("organisation_reference", S, True), ("organisation_name", S, True),
    ("compliance_scheme_id", L, True), ("organisation_id", L, True),
    ("submission_id", L, True), ("registration_date", S, True), ("brands_blob_name", S, True),
    ("brands_file_name", S, True), ("brands_file_id", S, True),
    ("partnership_blob_name", S, True), ("partnership_file_name", S, True),
    ("partnership_file_id", S, True), ("company_details_blob_name", S, True),
    ("company_details_file_name", S, True), ("company_details_file_id", S, True),
    ("postcode", S, True), ("country", S, True), ("county", S, True), ("town", S, True),
    ("dependent_locality", S, True), ("locality", S, True), ("street", S, True),
    ("building_number", S, True), ("building_name", S, True), ("sub_building_name", S, True),
    ("companies_house_number", S, True),
)

ORGANISATION_REGISTRATION_SUMMARY = _schema(
    ("submission_id", L, False), ("organisation_id", L, False), ("organisation_type", S, True),
    ("registration_journey", S, True), ("organisation_name", S, True),
    ("organisation_reference", S, True), ("submission_status", S, True),
    ("status_pending_date", S, True), ("application_reference_number", S, True),
    ("registration_reference_number", S, True), ("relevant_year", I, False),
    ("submitted_date_time", S, True), ("nation_id", I, False),
    ("regulator_decision_date", S, True), ("is_resubmission", B, False),
    ("resubmission_status", S, True), ("resubmission_date", S, True),
    ("registration_date", S, True),
)

ORGANISATION_REGISTRATION_DETAIL = _schema(
    ("submission_id", L, False), ("organisation_id", L, False), ("organisation_name", S, True),
    ("organisation_reference", S, True), ("application_reference_number", S, True),
    ("registration_reference_number", S, True), ("submission_status", S, True),
    ("status_pending_date", S, True), ("submitted_date_time", S, True),
    ("is_late_submission", B, False), ("submission_period", S, True),
    ("relevant_year", I, False), ("resubmission_file_id", S, True),
    ("registration_date", S, True), ("is_resubmission", B, False),
    ("resubmission_status", S, True), ("resubmission_date", S, True),
    ("is_compliance_scheme", B, False), ("organisation_size", S, True),
    ("organisation_type", S, True), ("registration_journey", S, True), ("nation_id", I, False),
    ("nation_code", S, True), ("regulator_comment", S, True), ("producer_comment", S, True),
    ("regulator_decision_date", S, True), ("regulator_resubmission_decision_date", S, True),
    ("regulator_user_id", S, True), ("companies_house_number", S, True),
    ("building_name", S, True), ("sub_building_name", S, True), ("building_number", S, True),
    ("street", S, True), ("locality", S, True), ("dependent_locality", S, True),
    ("town", S, True), ("county", S, True), ("country", S, True), ("postcode", S, True),
    ("submitted_user_id", L, True), ("first_name", S, True), ("last_name", S, True),
    ("email", S, True), ("telephone", S, True), ("service_role", S, True),
    ("service_role_id", I, True), ("is_online_market_place", B, False),
    ("number_of_subsidiaries", I, False), ("number_of_online_subsidiaries", I, False),
    ("number_of_holding_companies_closed_loop_recycling", I, False),
    ("number_of_subsidiaries_closed_loop_recycling", I, False),
    ("company_details_file_id", S, True), ("company_details_file_name", S, True),
    ("company_details_blob_name", S, True), ("partnership_file_id", S, True),
    ("partnership_file_name", S, True), ("partnership_blob_name", S, True),
    ("brands_file_id", S, True), ("brands_file_name", S, True), ("brands_blob_name", S, True),
    ("cso_json", S, True),
)

UPDATED_PRODUCERS = _schema(
    ("organisation_name", S, True), ("trading_name", S, True), ("organisation_type", S, True),
    ("companies_house_number", S, True), ("organisation_id", S, True),
    ("address_line1", S, True), ("address_line2", S, True), ("town", S, True),
    ("county", S, True), ("country", S, True), ("postcode", S, True), ("peprid", S, True),
    ("status", S, True), ("business_country", S, True), ("updated_date_time", TS, True),
)

UPDATED_PRODUCERS_V2 = _schema(
    *[(f.name, f.dataType, f.nullable) for f in UPDATED_PRODUCERS.fields
      if f.name != "organisation_id"],
    ("registration_year", S, True),
)

DUCKDB_TYPES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE",
}
DEFAULT_SQL = {"boolean": "false", "int": "0", "bigint": "0", "smallint": "0", "double": "0.0"}


def sql_select_list(schema: T.StructType, provided: dict[str, str]) -> str:
    """Oracle-side select list: the given SQL expressions, typed defaults elsewhere."""
    parts = []
    for f in schema.fields:
        t = f.dataType.simpleString()
        sql_t = DUCKDB_TYPES[t]
        if f.name in provided:
            expr = f"CAST({provided[f.name]} AS {sql_t})"
            if not f.nullable:
                expr = f"coalesce({expr}, CAST({DEFAULT_SQL[t]} AS {sql_t}))"
        elif f.nullable:
            expr = f"CAST(NULL AS {sql_t})"
        else:
            expr = f"CAST({DEFAULT_SQL[t]} AS {sql_t})"
        parts.append(f"{expr} AS {f.name}")
    return ",\n  ".join(parts)
