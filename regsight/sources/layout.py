"""Warehouse layout: submissions and POM lines stored by submission year.

The stand-in views derive submissions and POM lines from the driver tables
on every read. A deployment stores them once, partitioned by submission
year, so that year-bound reports (F6: the pay-calculation extracts, Q4: the
approved weights by year) read only their year's directories
(``PartitionFilters`` in the plan) instead of relying on row-group
statistics.

Within a year the rows are range partitioned on (organisation, submission)
before writing: files are clustered by organisation (tight min/max
statistics for organisation filters) and a hot year or a hot organisation is
spread over many write tasks, because the range key ends in a unique id.

``write_bucketed`` deals the same rows to buckets of the submission id instead,
for joins of submissions and lines without an exchange (Q3, Q15, J2).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regsight.sources import standin as V
from regsight.sources.tables import TABLE_PREFIX, read_path

SUBMISSIONS_DIR, POM_LINES_DIR = "submissions", "pom_lines"
CLUSTER_KEYS = ("submission_year", "organisation_id", "submission_id")


#: Point lookups (F7): a bloom filter per row group says whether the id can be in it.
LOOKUP_KEY = "submission_id"
BLOOM = {f"parquet.bloom.filter.enabled#{LOOKUP_KEY}": "true",
         f"parquet.bloom.filter.adaptive.enabled#{LOOKUP_KEY}": "true",
         "parquet.bloom.filter.adaptive.enabled": "true"}


def _writer(df: DataFrame, mode: str, options: dict | None):
    return df.write.mode(mode).options(**BLOOM, **(options or {})).partitionBy("submission_year")


def _write(df: DataFrame, path: str, num_files: int | None, mode: str, options: dict | None) -> None:
    n = num_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *CLUSTER_KEYS).sortWithinPartitions(*CLUSTER_KEYS)
    _writer(ranged, mode, options).parquet(path)


def write_warehouse(spark: SparkSession, sf_dir: str, out_dir: str, num_files: int | None = None,
                    mode: str = "overwrite", options: dict | None = None) -> dict[str, str]:
    """Materialise submissions and POM lines under ``out_dir`` (a shared folder).

    ``options`` go to the Parquet writer (row group size and the like).
    """
    subs_path = os.path.join(out_dir, SUBMISSIONS_DIR)
    lines_path = os.path.join(out_dir, POM_LINES_DIR)
    _write(V.submissions(spark, sf_dir, derive=True), subs_path, num_files, mode, options)
    _write(V.pom_lines(spark, sf_dir, derive=True), lines_path, num_files, mode, options)
    return {"submissions": subs_path, "pom_lines": lines_path}


def write_bucketed(spark: SparkSession, sf_dir: str, out_dir: str, buckets: int, prefix: str = "regsight",
                   options: dict | None = None) -> dict[str, str]:
    """The same two views, by year and in ``buckets`` of the submission id.

    Submissions and lines of an id share a bucket, so a join on it needs no
    exchange, and a lookup opens one bucket. Rows are dealt to the buckets
    before they are written (one file a year and bucket); an id's lines are few, so
    no bucket depends on a hot organisation. The tables are external ones of the
    session's catalog; ``open_bucketed`` names the files in another session.
    """
    made = {}
    for name, view in ((SUBMISSIONS_DIR, V.submissions(spark, sf_dir, derive=True)),
                       (POM_LINES_DIR, V.pom_lines(spark, sf_dir, derive=True))):
        table = f"{prefix}_{name}"
        (_writer(view.repartition(buckets, LOOKUP_KEY), "overwrite", options)
         .bucketBy(buckets, LOOKUP_KEY).sortBy(LOOKUP_KEY).option("path", os.path.join(out_dir, name))
         .saveAsTable(table))
        made[name] = TABLE_PREFIX + table
    return made


def open_bucketed(spark: SparkSession, out_dir: str, buckets: int, prefix: str = "regsight") -> dict[str, str]:
    """Name a layout of ``write_bucketed`` in this session's catalog; nothing is written."""
    made = {}
    for name in (SUBMISSIONS_DIR, POM_LINES_DIR):
        table, path = f"{prefix}_{name}", os.path.join(out_dir, name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read_path(spark, path).schema.fields)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (submission_year) "
                  f"CLUSTERED BY ({LOOKUP_KEY}) SORTED BY ({LOOKUP_KEY}) INTO {int(buckets)} BUCKETS "
                  f"LOCATION '{path}'")
        spark.sql(f"MSCK REPAIR TABLE {table}")
        made[name] = TABLE_PREFIX + table
    return made


def read_stored(spark: SparkSession, path: str, years=None) -> DataFrame:
    """Read a stored view; ``years`` prunes the year directories."""
    df = read_path(spark, path)
    if years is not None:
        df = df.filter(F.col("submission_year").isin([int(y) for y in years]))
    return df
