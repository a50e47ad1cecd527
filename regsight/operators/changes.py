"""F5 as true change sets: the difference of two vintages of a table.

A vintage is reduced to one row per key: how many rows it has and the sum of their
128-bit digests over the compared columns, so repeated rows count and their order
does not. Only these narrow rows are shuffled; the full rows of the keys that
differ are then taken from their vintage by a semi join.

Defined results: a null key is a key; null and empty text differ; columns that
only one vintage has are compared as null in the other; a key with several rows
is updated when any of them differs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERTED, UPDATED, REMOVED = "inserted", "updated", "removed"


def _digests(df: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    cells = [F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string") for c in columns]
    # a null cell takes no part in a hash: its place is hashed beside it
    nulls = F.concat_ws("", *[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cells])
    halves = [F.sum(F.xxhash64(F.lit(seed), nulls, *cells).cast("decimal(38,0)")).alias(f"d{seed}") for seed in (1, 2)]
    return (df.groupBy(*[F.col(k).alias(f"{name}_{k}") for k in keys])
            .agg(F.struct(F.count(F.lit(1)).alias("n"), *halves).alias(name)))


def changed_keys(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """``keys`` and ``change`` (inserted, updated or removed) of the keys that differ.

    ``columns`` are those compared; by default all but the keys.
    """
    columns = columns if columns is not None else [
        c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    a, b = _digests(old, keys, columns, "old"), _digests(new, keys, columns, "new")
    same = reduce(lambda x, y: x & y, [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in keys])
    both = a.join(b, same, "full")
    change = (F.when(F.col("old").isNull(), F.lit(INSERTED)).when(F.col("new").isNull(), F.lit(REMOVED))
              .when(F.col("old") != F.col("new"), F.lit(UPDATED)))
    return both.select(
        *[F.when(F.col("new").isNotNull(), F.col(f"new_{k}")).otherwise(F.col(f"old_{k}")).alias(k) for k in keys],
        change.alias("change")).filter("change is not null")


def change_set(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """``change`` and the rows behind it: the new ones, for removed keys the old ones (by ``new``'s columns)."""
    changes = changed_keys(old, new, keys, columns)
    named = changes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "change")

    def rows(df, wanted):
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        aligned = [F.col(c) if c in df.columns else F.lit(None).cast(new.schema[c].dataType).alias(c)
                   for c in new.columns]
        return df.join(named.filter(F.col("change").isin(*wanted)), same).select("change", *aligned)

    return rows(new, [INSERTED, UPDATED]).unionByName(rows(old, [REMOVED]))
