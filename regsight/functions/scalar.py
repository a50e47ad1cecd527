"""Scalar mappings used by the reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SIZE_SMALL, SIZE_LARGE, SIZE_UNKNOWN = "Small", "Large", "Unknown"
PERIOD_START_MONTH, PERIOD_START_DAY = 2, 1  # February 1
READY, NO_CONTENT, SCHEMA_MISSING, REFERENCE_MISSING = (
    "ready", "no_content", "schema_missing", "reference_missing")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# P3 ------------------------------------------------------------------------
def map_org_size(col) -> Column:
    """``s`` -> Small, ``l`` -> Large in any case; everything else Unknown (no trim)."""
    low = F.lower(_c(col))
    return (F.when(low == "s", F.lit(SIZE_SMALL))
            .when(low == "l", F.lit(SIZE_LARGE))
            .otherwise(F.lit(SIZE_UNKNOWN)))


# P5 ------------------------------------------------------------------------
def derive_period_year(as_of: dt.date, start_month: int = PERIOD_START_MONTH,
                       start_day: int = PERIOD_START_DAY) -> int:
    """Year whose data is reported: last year once the start day has passed."""
    start = dt.date(as_of.year, start_month, start_day)
    return as_of.year - 1 if as_of >= start else as_of.year - 2


def periods_for_year(year: int) -> str:
    """Period list of a year: ``Y-P1,Y-P4`` up to 2024, ``Y-H1,Y-H2`` after."""
    return f"{year}-P1,{year}-P4" if year <= 2024 else f"{year}-H1,{year}-H2"


def period_year_col(as_of, start_month: int = PERIOD_START_MONTH,
                    start_day: int = PERIOD_START_DAY) -> Column:
    """Column form of P5, for a column of as-of dates."""
    d = _c(as_of)
    start = F.make_date(F.year(d), F.lit(start_month), F.lit(start_day))
    return F.when(d >= start, F.year(d) - 1).otherwise(F.year(d) - 2)


def periods_col(year) -> Column:
    y = _c(year)
    ys = y.cast("string")
    return (F.when(y <= 2024, F.concat(ys, F.lit("-P1,"), ys, F.lit("-P4")))
            .otherwise(F.concat(ys, F.lit("-H1,"), ys, F.lit("-H2"))))


# P6 ------------------------------------------------------------------------
def classify_readiness(row_found, field_available, reference) -> Column:
    """Outcome of a pay-parameter lookup, checked in this order."""
    ref = _c(reference)
    return (F.when(~F.coalesce(_c(row_found), F.lit(False)), F.lit(NO_CONTENT))
            .when(~F.coalesce(_c(field_available), F.lit(False)), F.lit(SCHEMA_MISSING))
            .when(ref.isNull() | (F.trim(ref) == ""), F.lit(REFERENCE_MISSING))
            .otherwise(F.lit(READY)))


# P7 ------------------------------------------------------------------------
def fold_flag(col) -> Column:
    """Null (or no row after a left join) -> false."""
    return F.coalesce(_c(col), F.lit(False))
