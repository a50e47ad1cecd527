"""Parquet scans of the warehouse tables.

Scans are plain ``spark.read.parquet`` with an explicit column list, so the
physical plan shows a pruned ``ReadSchema``; filters written on raw columns
reach the scan as ``PushedFilters``.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def session_key(spark: SparkSession) -> int:
    """Identity of the session behind ``spark`` (for per-session caches)."""
    return id(getattr(spark, "_jsparkSession", spark))


TABLE_PREFIX = "table:"


def is_table(path: str) -> bool:
    return path.startswith(TABLE_PREFIX)


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """``spark.read.parquet(path)``, or a table of the catalog named ``table:...``.

    The files are those that are there now, nothing is kept between reports:
    several of them ask what has just landed.
    """
    return spark.table(path.removeprefix(TABLE_PREFIX)) if is_table(path) else spark.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = read_path(spark, table_path(sf_dir, name))
    return df.select(*columns) if columns else df


# The submission-event table, scanned with a declared schema and the
# load column exposed under its model name.
SUBMISSION_EVENT_SCAN_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def scan_events(spark: SparkSession, sf_dir: str,
                schema: T.StructType = SUBMISSION_EVENT_SCAN_SCHEMA,
                renames: dict[str, str] | None = None) -> DataFrame:
    """Declared-schema scan of a keyless table plus column renames."""
    renames = renames if renames is not None else {"ts": "last_sync_time"}
    df = spark.read.schema(schema).parquet(table_path(sf_dir, "events"))
    return df.withColumnsRenamed(renames) if renames else df


def instant_text(value: dt.datetime | str) -> str:
    """A date-time as UTC text with its microseconds; one without a zone is UTC already."""
    if isinstance(value, str):
        return value
    if value.tzinfo is not None:
        value = value.astimezone(dt.UTC)
    return value.strftime("%Y-%m-%d %H:%M:%S.%f")


def ts_ntz(text: str):
    """A ``timestamp_ntz`` literal (keeps comparisons with NTZ columns pushable)."""
    return F.lit(text).cast(T.TimestampNTZType())
