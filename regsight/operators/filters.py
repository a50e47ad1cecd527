"""Filters and predicates.

Every filter is a plain predicate on a named column, so Catalyst can push it
below joins and into the parquet scan when the column is a raw one. Absent
parameters (``None``) add no predicate at all.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regsight.sources.tables import instant_text, ts_ntz

MIN_RELATIVE_YEAR, MAX_RELATIVE_YEAR = 2025, 9999


def csv_items(csv: str | None) -> list[str] | None:
    """Items of a comma-separated parameter; None when absent or blank."""
    if csv is None:
        return None
    items = [x.strip() for x in csv.split(",")]
    items = [x for x in items if x]
    return items or None


# F1 ------------------------------------------------------------------------
def filter_csv(df: DataFrame, col: str, csv: str | None) -> DataFrame:
    """Membership in a comma-separated list; absent or blank list = no filter."""
    items = csv_items(csv)
    return df if items is None else df.filter(F.col(col).isin(items))


# F2 ------------------------------------------------------------------------
def filter_optional_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Equality when a value is given."""
    return df if value is None else df.filter(F.col(col) == F.lit(value))


def validate_nation(nation_id: int | None) -> int | None:
    if nation_id is not None and not 1 <= int(nation_id) <= 4:
        raise ValueError(f"nation id must be between 1 and 4, got {nation_id}")
    return nation_id


# F3 ------------------------------------------------------------------------
def filter_name(df: DataFrame, name_col: str | None = None, name: str | None = None,
                reference_col: str | None = None, reference: str | None = None) -> DataFrame:
    """Name: case-insensitive contains. Reference: exact match."""
    if name:
        df = df.filter(F.lower(F.col(name_col)).contains(name.lower()))
    if reference:
        df = df.filter(F.col(reference_col) == F.lit(reference))
    return df


# F4 ------------------------------------------------------------------------
def filter_approved_after(df: DataFrame, col: str, after: dt.datetime | str | None) -> DataFrame:
    """Rows whose decision instant is strictly after ``after``."""
    if after is None:
        return df
    return df.filter(F.col(col) > ts_ntz(instant_text(after)))


# F5 ------------------------------------------------------------------------
def filter_delta_window(df: DataFrame, col: str, start, end) -> DataFrame:
    """Rows updated in ``[start, end]`` (inclusive); start > end gives no rows."""
    return df.filter(F.col(col).between(ts_ntz(instant_text(start)), ts_ntz(instant_text(end))))


# F6 ------------------------------------------------------------------------
def validate_relative_year(year) -> int:
    """Reject before any job starts (the underlying scans are expensive)."""
    if year is None or isinstance(year, bool):
        raise ValueError("relative year is required")
    year = int(year)
    if not MIN_RELATIVE_YEAR <= year <= MAX_RELATIVE_YEAR:
        raise ValueError(f"relative year must be between {MIN_RELATIVE_YEAR} and "
                         f"{MAX_RELATIVE_YEAR}, got {year}")
    return year


def filter_relative_year(df: DataFrame, col: str, relative_year, offset: int = 0) -> DataFrame:
    """``col == relative_year - offset`` (POM rows use offset 1, organisations 0)."""
    year = validate_relative_year(relative_year)
    return df.filter(F.col(col) == F.lit(year - offset))


# F7 ------------------------------------------------------------------------
def filter_key(df: DataFrame, col: str, key) -> DataFrame:
    """Point lookup by one id, or bulk lookup by a DataFrame of ids (semi join)."""
    if isinstance(key, DataFrame):
        ids = key.select(F.col(key.columns[0]).alias(col))
        return df.join(ids, col, "left_semi").select(*df.columns)
    if key is None or (isinstance(key, str) and not key.strip()):
        raise ValueError(f"{col} must not be empty")
    return df.filter(F.col(col) == F.lit(key))


def any_of(*preds: Column) -> Column:
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out
