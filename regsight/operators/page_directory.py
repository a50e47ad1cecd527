"""L1/L2 over a list that is paged again and again: a stored order with fences.

``write_directory`` range-partitions a list once on its order, stores each range
sorted under its number, and keeps a directory of one row per range: how many
rows it holds and how many lie before it. A page then is found in the
directory and read from the one or two ranges that hold it, however deep it is; the
total and the clamp need no count. Without a directory every request ranges
the list anew (``paging.deep_page_rows``).

Ranges are told apart by the order itself, so the columns of ``order_cols`` must end in
a unique key; nulls and ties of the earlier columns stand where the order puts
them. A directory is a snapshot: ``as_of`` names the state it was made from (the
last sync time, say), and a page for another state is refused.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regsight.operators.paging import Page, _validate_page, clamp_page

RANGE, ROWS, FENCES, ABOUT = "_range", "rows", "fences", "about"
RANGE_ROWS = 1_000_000
MANY_RANGES = 1_000   # a range is a folder, a task and an entry of the driver's: of more, each holds more rows


@dataclass
class PageDirectory:
    path: str
    total: int
    ranges: int
    as_of: str | None
    columns: list[str]
    schema: str


def write_directory(df: DataFrame, path: str, order_cols: list, as_of: str | None = None,
                    range_rows: int = RANGE_ROWS) -> PageDirectory:
    """Store ``df`` in order with its fences; ranges hold about ``range_rows`` rows.

    Where that would be more than ``MANY_RANGES`` ranges, they hold as many more rows,
    up to ``RANGE_ROWS``; a page is the same rows from whatever ranges hold it.
    """
    spark = df.sparkSession
    if RANGE in df.columns:
        raise ValueError(f"{RANGE} is the directory's own column")
    rows = df.count()
    ranges = max(1, -(-rows // max(range_rows, min(RANGE_ROWS, -(-rows // MANY_RANGES)))))
    (df.repartitionByRange(ranges, *order_cols).sortWithinPartitions(*order_cols)
     .withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).parquet(os.path.join(path, ROWS)))
    counts = _stored(spark, path, df).groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    # one row per range
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    (counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
     .coalesce(1).write.parquet(os.path.join(path, FENCES)))
    total = spark.read.parquet(os.path.join(path, FENCES)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    about = {"total": int(total), "ranges": ranges, "as_of": as_of, "columns": df.columns,
             "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(os.path.join(path, ABOUT))
    return PageDirectory(path, **about)


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored rows; an empty list has no files."""
    schema = T.StructType([*like.schema.fields, T.StructField(RANGE, T.IntegerType())])
    return spark.read.schema(schema).parquet(os.path.join(path, ROWS))


def open_directory(spark: SparkSession, path: str, as_of: str | None = None) -> PageDirectory:
    about = json.loads(spark.read.text(os.path.join(path, ABOUT)).first()[0])
    if as_of is not None and about["as_of"] != as_of:
        raise ValueError(f"the directory was made as of {about['as_of']}, not {as_of}")
    return PageDirectory(path, **about)


def directory_rows(spark: SparkSession, directory: PageDirectory, order_cols: list, start: int,
                   size: int) -> DataFrame:
    """Rows ``start + 1 .. start + size`` of the stored order."""
    if not directory.total:
        return spark.createDataFrame([], directory.schema)
    rows = spark.read.parquet(os.path.join(directory.path, ROWS))
    inside = (F.col("before") < start + size) & (F.col("before") + F.col("n") > start)
    # the ranges of a page: two, or as many as its own rows fill
    held = spark.read.parquet(os.path.join(directory.path, FENCES)).filter(inside) \
        .agg(F.min(RANGE), F.max(RANGE), F.min("before")).first()
    if held[0] is None:
        return rows.select(*directory.columns).limit(0)
    return (rows.filter(F.col(RANGE).between(held[0], held[1])).select(*directory.columns)
            .orderBy(*order_cols).offset(int(start - held[2])).limit(int(size)))


def directory_page(spark: SparkSession, directory: PageDirectory, order_cols: list, page: int, size: int,
                   clamped: bool = True) -> Page:
    """L2 (L1 without ``clamped``) from a directory, with the total of its list."""
    _validate_page(max(1, int(page)) if clamped else page, size)
    current = clamp_page(int(page), int(size), directory.total) if clamped else int(page)
    rows = directory_rows(spark, directory, order_cols, (current - 1) * int(size), int(size))
    return Page(rows.withColumn("total_items", F.lit(directory.total).cast("long")), current, int(size),
                directory.total)
