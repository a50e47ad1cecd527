"""Aggregations.

Every aggregate is a ``groupBy(...).agg(...)`` with algebraic functions
(sum, count, max, bool_or, max_by), so Spark combines partial results on the
map side before the shuffle and a hot key never ships its raw rows to one
task. Distinct counts are written as two aggregation levels for the same
reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHT_DECIMAL = T.DecimalType(18, 2)


# A1 ------------------------------------------------------------------------
def max_sync_time(events: DataFrame, col: str = "load_ts", out: str = "last_sync_time") -> DataFrame:
    """One row: the latest load timestamp (null for an empty table)."""
    return events.agg(F.max(col).alias(out))


def last_sync_time_value(events: DataFrame, col: str = "load_ts"):
    """Driver value of A1; the reference requires a non-null maximum."""
    value = max_sync_time(events, col).first()[0]
    if value is None:
        raise ValueError("no submission events: last sync time is undefined")
    return value


def _exact_weight(col: str) -> F.Column:
    # sum exactly in decimal, then truncate to int (our definition of the rounding)
    return F.sum(F.col(col).cast(WEIGHT_DECIMAL))


# A2 ------------------------------------------------------------------------
APPROVED_KEYS = ("submission_period", "packaging_material", "organisation_id",
                 "submitter_id", "submitter_type")


def approved_weights(lines: DataFrame, weight_col: str = "packaging_material_weight",
                     keys=APPROVED_KEYS) -> DataFrame:
    """Total weight per key; days obligated is always null in this variant."""
    return (lines.groupBy(*keys)
            .agg(_exact_weight(weight_col).alias("_w"))
            .select(*keys, F.col("_w").cast("long").alias("packaging_material_weight"),
                    F.lit(None).cast(T.ShortType()).alias("number_of_days_obligated")))


# A3 ------------------------------------------------------------------------
def approved_weights_by_year(lines: DataFrame, weight_col: str = "packaging_material_weight",
                             keys=APPROVED_KEYS,
                             days_col: str = "number_of_days_obligated") -> DataFrame:
    """As A2 with days obligated as a further (nullable) key."""
    all_keys = (*keys, days_col)
    return (lines.groupBy(*all_keys)
            .agg(_exact_weight(weight_col).alias("_w"))
            .select(*keys, F.col("_w").cast("long").alias("packaging_material_weight"),
                    F.col(days_col).cast(T.ShortType()).alias("number_of_days_obligated")))


# A4 ------------------------------------------------------------------------
def fee_counts(lines: DataFrame, group_keys: list[str], member_col: str,
               member_flags: dict[str, str], own_flags: dict[str, str]) -> DataFrame:
    """Per group: distinct members, distinct members having each flag, own flags.

    ``member_flags`` maps an output count to a boolean line column;
    ``own_flags`` maps an output flag to a boolean group attribute.
    Level 1 de-duplicates (group, member) with partial aggregation; level 2
    counts per group.
    """
    per_member = (lines.groupBy(*group_keys, member_col)
                  .agg(*[F.bool_or(F.col(src)).alias(f"_m_{out}") for out, src in member_flags.items()],
                       *[F.bool_or(F.col(src)).alias(f"_o_{out}") for out, src in own_flags.items()]))
    return (per_member.groupBy(*group_keys)
            .agg(F.count(F.lit(1)).cast("int").alias("number_of_subsidiaries"),
                 *[F.count_if(F.col(f"_m_{out}")).cast("int").alias(out) for out in member_flags],
                 *[F.bool_or(F.col(f"_o_{out}")).alias(out) for out in own_flags]))


# A5 ------------------------------------------------------------------------
def member_counts(lines: DataFrame, key: str, member_col: str, out: str = "member_count") -> DataFrame:
    """Distinct members per key: two hash aggregates over (key, member) alone."""
    return (lines.select(key, member_col).groupBy(key, member_col).agg(F.lit(1).alias("_one"))
            .groupBy(key).agg(F.count(F.lit(1)).cast("int").alias(out)))


def resubmission_parameters(subs: DataFrame, lines: DataFrame, key: str, member_col: str, date_col: str,
                            resub_col: str, nation_col: str) -> DataFrame:
    """Per submission: resubmission flag and date, member count, nation code.

    ``subs`` says which submissions there are, one row each; one without
    lines has no members but is found.
    """
    return subs.join(member_counts(lines, key, member_col), key, "left").select(
        key, F.col(resub_col).alias("is_resubmission"),
        F.when(F.col(resub_col), F.col(date_col)).alias("resubmission_date"),
        F.coalesce("member_count", F.lit(0)).alias("member_count"), F.col(nation_col).alias("nation_code"))


# A6 ------------------------------------------------------------------------
def half_year_flags(df: DataFrame, keys: list[str], period_col: str = "submission_period") -> DataFrame:
    """Per key: has a first-half / second-half submission."""
    p = F.col(period_col)
    return df.groupBy(*keys).agg(
        F.coalesce(F.bool_or(p.endswith("-H1")), F.lit(False)).alias("has_h1"),
        F.coalesce(F.bool_or(p.endswith("-H2")), F.lit(False)).alias("has_h2"))
