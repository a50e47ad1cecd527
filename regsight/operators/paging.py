"""Windows, sort and limit.

W1 uses a scalar subquery for the total instead of ``count(*) over ()``,
which would move every row into one partition. W2 windows ordinary groups
directly and splits hot (organisation, year) groups over several tasks:
their rows are range partitioned on the group *and* its order, each piece is
windowed on its own, and the first row of a piece takes its predecessor from
a small per-piece summary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regsight.session import cut_lineage


@dataclass
class Page:
    """A page of rows plus the response metadata.

    ``items`` carries the ``total_items`` bookkeeping column (W1), as the
    reference's page rows do; ``response_items()`` strips it (P4).
    """
    items: DataFrame
    current_page: int
    page_size: int
    known_total: int | None = None

    def total_items(self) -> int:
        """Total from the first row, 0 when the page is empty (runs a job if unknown)."""
        if self.known_total is None:
            first = self.items.select("total_items").first()
            self.known_total = int(first[0]) if first is not None else 0
        return self.known_total

    def response_items(self) -> DataFrame:
        return self.items.drop("total_items")


def _validate_page(page: int, size: int) -> None:
    if size is None or int(size) < 1:
        raise ValueError(f"page size must be at least 1, got {size}")
    if page is None or int(page) < 1:
        raise ValueError(f"page number must be at least 1, got {page}")


# W1 ------------------------------------------------------------------------
def with_total_items(df: DataFrame, out: str = "total_items") -> DataFrame:
    """Every row carries the row count of ``df`` (a scalar subquery, no global window)."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.withColumn(out, total)


# W2 ------------------------------------------------------------------------
HOT_GROUP_ROWS = 2_000_000   # a group larger than this is split over several tasks
MAX_BROADCAST_HOT_GROUPS = 100_000


def resubmission_history(df: DataFrame, group_cols: list[str], order_cols: list[str],
                         status_col: str, comments_col: str, rejected: str = "Rejected",
                         num_pieces: int | None = None,
                         hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Flag later submissions of a group as resubmissions and carry the
    comments of the submission just before, when that one was rejected.

    Equivalent to ``row_number() > 1`` and ``lag(comments if rejected)`` over
    ``partitionBy(group_cols).orderBy(order_cols)``; ``group_cols`` +
    ``order_cols`` must identify a row.

    A plain window puts a whole group into one task. Group sizes are counted
    first (a partially aggregated ``groupBy().count()``); groups of at most
    ``hot_rows`` rows take the plain window, larger ("hot") groups take
    ``split_history``, which spreads one group over many tasks. The number of
    hot groups is at most rows / ``hot_rows``; their key list is broadcast
    only under a checked bound.
    """
    keys = [*group_cols, *order_cols]
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > hot_rows).select(*group_cols)
    n_hot = hot.limit(MAX_BROADCAST_HOT_GROUPS + 1).count()
    if n_hot == 0:
        return _window_history(df, group_cols, order_cols, status_col, comments_col, rejected)
    hot_side = renamed(hot, group_cols)
    hot_side = F.broadcast(hot_side) if n_hot <= MAX_BROADCAST_HOT_GROUPS else hot_side
    cold = df.join(hot_side, same_as(df, group_cols), "left_anti")
    hot_rows_df = df.join(hot_side, same_as(df, group_cols), "left_semi")
    cold_out = _window_history(cold, group_cols, order_cols, status_col, comments_col, rejected)
    hot_out = split_history(hot_rows_df, group_cols, order_cols, status_col, comments_col,
                            rejected, num_pieces)
    out_cols = [*df.columns, "is_resubmission", "previous_rejection_comments"]
    return cold_out.select(*out_cols).unionByName(hot_out.select(*out_cols))


def renamed(df: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` under other names, for a null-safe join back to the frame they come from."""
    return df.withColumnsRenamed({c: f"_same_{c}" for c in cols})


def same_as(df: DataFrame, cols: list[str]):
    """Equality with the renamed columns in which null equals null."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in cols])


def _window_history(df, group_cols, order_cols, status_col, comments_col, rejected):
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    rc = F.when(F.col(status_col) == rejected, F.col(comments_col))
    return (df.withColumn("is_resubmission", F.row_number().over(w) > 1)
            .withColumn("previous_rejection_comments", F.lag(rc).over(w)))


def split_history(df: DataFrame, group_cols: list[str], order_cols: list[str],
                  status_col: str, comments_col: str, rejected: str = "Rejected",
                  num_pieces: int | None = None) -> DataFrame:
    """W2 for hot groups: one group is spread over many tasks.

    The narrow key columns are range partitioned on group *and* order, so a
    hot group spans several pieces; the piece id is materialised by a
    reliable checkpoint (both branches below must see the same pieces), each
    piece is windowed on its own, and the first row of a piece takes its
    predecessor from a per-piece summary (one row per piece and group). The
    flags are joined back on the row key.
    """
    spark = df.sparkSession
    n = num_pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    rc = F.when(F.col(status_col) == rejected, F.col(comments_col))
    narrow = df.select(*keys, rc.alias("_rc"))
    ranged = cut_lineage(narrow.repartitionByRange(n, *keys)
                         .withColumn("_piece", F.spark_partition_id()))
    w = Window.partitionBy("_piece", *group_cols).orderBy(*order_cols)
    local = (ranged.withColumn("_rn", F.row_number().over(w))
             .withColumn("_lag_rc", F.lag("_rc").over(w)))
    last = F.max(F.struct(*[F.col(c) for c in order_cols], F.col("_rc").alias("_v")))
    pieces = ranged.groupBy("_piece", *group_cols).agg(last["_v"].alias("_last_rc"))
    wp = Window.partitionBy(*group_cols).orderBy("_piece")
    pieces = pieces.select("_piece", *group_cols,
                           F.lag("_piece").over(wp).isNotNull().alias("_has_prev"),
                           F.lag("_last_rc").over(wp).alias("_prev_rc"))
    first_in_piece = F.col("_rn") == 1
    marks = ["_piece", *group_cols]
    flags = (local.join(renamed(pieces, marks), same_as(local, marks), "left")
             .select(*keys,
                     (~first_in_piece | F.col("_has_prev")).alias("is_resubmission"),
                     F.when(first_in_piece, F.col("_prev_rc")).otherwise(F.col("_lag_rc"))
                     .alias("previous_rejection_comments")))
    return df.join(renamed(flags, keys), same_as(df, keys), "left").select(
        *df.columns, "is_resubmission", "previous_rejection_comments")


# L1 ------------------------------------------------------------------------
MAX_BROADCAST_PAGE = 100_000
DEEP_PAGE_ROWS = 100_000  # above this offset + size, pages are cut out distributed


def page_rows(df: DataFrame, order_cols: list, page: int, size: int,
              deep_threshold: int = DEEP_PAGE_ROWS, key_cols: list[str] | None = None) -> DataFrame:
    """Rows of page ``page`` (1-based) of size ``size`` in ``order_cols`` order.

    Shallow pages are planned as ``TakeOrderedAndProject`` with an offset:
    every task keeps its best ``offset + size`` rows. Deeper pages (the last
    page of a clamped list can be billions of rows deep) use
    ``deep_page_rows``, which never gathers more than one page in a task.
    ``key_cols`` (the columns ``order_cols`` are built from, identifying a
    row) lets the deep path rank only those columns.
    """
    _validate_page(page, size)
    start = (int(page) - 1) * int(size)
    if start + int(size) <= deep_threshold:
        return df.orderBy(*order_cols).offset(start).limit(int(size))
    return deep_page_rows(df, order_cols, start, int(size), key_cols=key_cols)


def deep_page_rows(df: DataFrame, order_cols: list, start: int, size: int,
                   num_partitions: int | None = None,
                   key_cols: list[str] | None = None) -> DataFrame:
    """Rows ``start + 1 .. start + size`` of ``df`` in ``order_cols`` order, distributed.

    Range partitioning puts contiguous slices of the order in partitions
    ``0..n-1``; the partition id is materialised by a reliable checkpoint so
    that the row numbers and the per-partition counts below see the same
    partitions. The global position of a row is the number of rows in
    earlier partitions plus its position in its own partition. The
    per-partition counts have one row per partition, a proven bound, so
    they are broadcast. ``order_cols`` must end in a unique key.

    With ``key_cols`` only those columns are ranked and checkpointed; the
    page's keys are then joined back to ``df``, nulls included; they are
    broadcast only up to ``MAX_BROADCAST_PAGE`` rows.
    """
    if key_cols:
        keys = deep_page_rows(df.select(*key_cols), order_cols, start, size, num_partitions)
        side = renamed(keys, key_cols)
        if size <= MAX_BROADCAST_PAGE:
            side = F.broadcast(side)
        return (df.join(side, same_as(df, key_cols), "left_semi")
                .select(*df.columns).orderBy(*order_cols))
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order_cols)
                         .withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn("_pos", F.row_number().over(
        Window.partitionBy("_pid").orderBy(*order_cols)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"))
    pos = F.col("_before") + F.col("_pos")
    return (local.join(F.broadcast(before), "_pid")
            .filter((pos > start) & (pos <= start + size))
            .orderBy(*order_cols)
            .drop("_pid", "_pos", "_before"))


def page_plain(df: DataFrame, order_cols: list, page: int, size: int,
               deep_threshold: int = DEEP_PAGE_ROWS, key_cols: list[str] | None = None) -> Page:
    """L1: page number echoed unchanged; past the end -> no rows and total 0."""
    rows = page_rows(with_total_items(df), order_cols, page, size, deep_threshold, key_cols)
    return Page(rows, int(page), int(size))


# L2 ------------------------------------------------------------------------
def clamp_page(page: int, size: int, total: int) -> int:
    """The page asked for, held between the first page and the last one with rows."""
    _validate_page(max(1, page), size)
    return max(1, min(page, math.ceil(total / size)))


def page_clamped(df: DataFrame, order_cols: list, page: int, size: int,
                 deep_threshold: int = DEEP_PAGE_ROWS, key_cols: list[str] | None = None) -> Page:
    """L2: count first, clamp on the driver, then fetch the clamped page."""
    _validate_page(max(1, int(page)), size)
    total = df.count()
    current = clamp_page(int(page), int(size), total)
    rows = page_rows(df, order_cols, current, size, deep_threshold, key_cols) \
        .withColumn("total_items", F.lit(total).cast("long"))
    return Page(rows, current, int(size), int(total))


# L3 ------------------------------------------------------------------------
def first_or_none(df: DataFrame, order_cols: list) -> DataFrame:
    """At most one row, chosen by an explicit order."""
    return df.orderBy(*order_cols).limit(1)


def first_per_key(df: DataFrame, key: str | list[str], order_cols: list[str]) -> DataFrame:
    """Bulk L3: the first row per key by ``order_cols`` (an aggregate combined on the map side, no window)."""
    keys = [key] if isinstance(key, str) else list(key)
    value_cols = [c for c in df.columns if c not in keys]
    ordering = F.struct(*order_cols)
    payload = F.struct(*[F.col(c) for c in value_cols])
    return (df.groupBy(*keys).agg(F.min_by(payload, ordering).alias("_v"))
            .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value_cols]))
