"""Projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Result column order of the pay-calculation extracts (fixed).
ORGANISATION_EXTRACT_COLUMNS = (
    "organisation_id", "subsidiary_id", "organisation_name", "trading_name", "status_code",
    "error_code", "joiner_date", "leaver_date", "obligation_status", "num_days_obligated",
    "submitter_id", "has_h1", "has_h2")
POM_EXTRACT_COLUMNS = (
    "submission_period", "submission_period_description", "organisation_id", "subsidiary_id",
    "packaging_type", "packaging_material", "packaging_material_subtype",
    "packaging_material_weight", "packaging_class", "packaging_activity", "submitter_id",
    "ram_rag_rating")

POM_DECISION_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("FileId", T.StringType()),
    T.StructField("Decision", T.StringType()),
    T.StructField("Comments", T.StringType()),
    T.StructField("IsResubmissionRequired", T.BooleanType()),
]))
REGISTRATION_DECISION_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("FileId", T.StringType()),
    T.StructField("Decision", T.StringType()),
    T.StructField("Comments", T.StringType()),
]))


def _non_null(col: str, dtype: T.DataType, what: str) -> Column:
    return F.coalesce(F.col(col), F.raise_error(F.lit(f"{what}: {col} is null")).cast(dtype))


# P1 ------------------------------------------------------------------------
def project_organisation(df: DataFrame) -> DataFrame:
    """14 -> 13 columns (no period year); the organisation id must be present."""
    dtype = df.schema["organisation_id"].dataType
    exprs = [_non_null(c, dtype, "organisation extract").alias(c) if c == "organisation_id"
             else F.col(c) for c in ORGANISATION_EXTRACT_COLUMNS]
    return df.select(*exprs)


# P2 ------------------------------------------------------------------------
def project_pom(df: DataFrame) -> DataFrame:
    """12 -> 12 columns in extract order; the organisation id must be present."""
    dtype = df.schema["organisation_id"].dataType
    exprs = [_non_null(c, dtype, "POM extract").alias(c) if c == "organisation_id"
             else F.col(c) for c in POM_EXTRACT_COLUMNS]
    return df.select(*exprs)


# P4 ------------------------------------------------------------------------
def strip_bookkeeping(df: DataFrame, cols=("total_items",)) -> DataFrame:
    return df.drop(*cols)


# P8 ------------------------------------------------------------------------
def decode_decisions(df: DataFrame, col: str, schema: T.ArrayType = POM_DECISION_SCHEMA,
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON array text -> one row per decision; null or empty -> no rows.

    Malformed text fails the job: half a request must not be applied.
    """
    arr = F.from_json(F.coalesce(F.nullif(F.trim(F.col(col)), F.lit("")), F.lit("[]")), schema,
                      {"mode": "FAILFAST"})
    return df.select(*keep, F.inline(arr))


def encode_decisions(cols: list[str]) -> Column:
    """Struct columns -> one-element JSON array text (per row, no grouping)."""
    return F.to_json(F.array(F.struct(*cols)))


REQUEST_MAX_DECISIONS = 10_000


def encode_decisions_request(df: DataFrame, cols: list, order_cols: list[str] | None = None,
                             max_rows: int = REQUEST_MAX_DECISIONS) -> str:
    """The JSON array text of a request (``to_json(collect_list(struct))``).

    A request is small by nature; the frame is gathered into one array only
    after a bounded count proves it has at most ``max_rows`` rows. The array
    is sorted by ``order_cols`` (collect order is not defined after a
    shuffle, and the overlay lets the last entry per file win). Empty input
    gives ``[]``. Nothing is dropped: a larger delta is refused here and is
    passed to the reports as a DataFrame instead, which J1 joins without
    gathering it.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"a decisions request holds at most {max_rows} entries")
    item = F.struct(*cols)
    if order_cols:
        keyed = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols],
                                                     item.alias("_v"))))
        arr = F.transform(keyed, lambda x: x["_v"])
    else:
        arr = F.collect_list(item)
    row = df.agg(F.to_json(arr).alias("j")).first()
    return row.j if row is not None and row.j is not None else "[]"
