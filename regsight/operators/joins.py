"""Joins (J1-J5) and the size-checked broadcast they rely on.

All joins are equi-joins. A side is broadcast only after a bounded count
proves it holds at most ``max_rows`` rows; beyond that the join stays a
shuffle join and AQE (skew-join splitting on) handles hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regsight.functions.scalar import fold_flag
from regsight.session import cut_lineage

DEFAULT_BROADCAST_ROWS = 200_000


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    A plain count: each task sends one record on. A limit before it would send
    up to ``max_rows`` records of every task to a single one.
    """
    return df.count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      bound_from: DataFrame | None = None) -> DataFrame:
    """``broadcast(df)`` if it provably has at most ``max_rows`` rows, else ``df``.

    ``bound_from`` is a frame with at least as many rows as ``df`` (for
    example its input before de-duplication); checking it is cheaper when
    ``df`` itself ends in an aggregation.
    """
    probe = bound_from if bound_from is not None else df
    return F.broadcast(df) if has_at_most(probe, max_rows) else df


def latest_per_key(df: DataFrame, key: str, order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """One row per key: the values of the row with the greatest ``order_cols``.

    An aggregate (by sort, its buffer being a struct) that is combined on the
    map side, so a hot key is reduced on every mapper before the shuffle.
    """
    ordering = F.struct(*order_cols)
    payload = F.struct(*value_cols)
    return (df.groupBy(key)
            .agg(F.max_by(payload, ordering).alias("_v"))
            .select(key, *[F.col(f"_v.{c}").alias(c) for c in value_cols]))


# J1 ------------------------------------------------------------------------
def overlay_decisions(df: DataFrame, delta: DataFrame, key: str = "file_id",
                      overlay_cols=("decision", "comments"), order_cols: list[str] | None = None,
                      max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Overlay pending decisions on stored rows by ``key``.

    Our definition: the last entry per key wins (by ``order_cols``); delta
    entries without a stored row are ignored; a null delta value keeps the
    stored one.
    """
    overlay_cols = list(overlay_cols)
    raw = delta
    if not order_cols:
        raise ValueError("name the columns that order the entries of a key")
    delta = latest_per_key(delta, key, order_cols, overlay_cols)
    renamed = delta.select(key, *[F.col(c).alias(f"_new_{c}") for c in overlay_cols])
    # one row per key after de-duplication, so the raw delta's size bounds it
    side = bounded_broadcast(renamed, max_broadcast_rows, bound_from=raw)
    joined = df.join(side, key, "left")
    return joined.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in overlay_cols else F.col(c)
          for c in df.columns])


def split_hot_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
                   hot_rows: int = 2_000_000, max_hot_keys: int = 100_000) -> DataFrame:
    """Many-to-one join that does not depend on AQE for a hot key of ``big``.

    Keys with more than ``hot_rows`` rows in ``big`` are found by a
    partially aggregated count; their rows of ``small`` (one per key) are
    broadcast, so hot rows join without being shuffled to one task. Where
    that would be more than ``max_hot_keys`` keys, the bound on rows doubles
    until the hottest fit. All other keys take the ordinary join. ``small``
    must be unique on ``key``; ``how`` is inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("split_hot_join supports inner and left joins")
    hot = cut_lineage(big.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows))
    while not has_at_most(hot, max_hot_keys):
        hot_rows = max(2 * hot_rows, 1)
        hot = hot.filter(F.col("_n") > hot_rows)
    if hot.isEmpty():
        return big.join(small, key, how)
    hot_keys = F.broadcast(hot.select(key))
    hot_small = F.broadcast(small.join(hot_keys, key, "left_semi"))
    hot_part = big.join(hot_keys, key, "left_semi").join(hot_small, key, how)
    cold_part = big.join(hot_keys, key, "left_anti").join(small, key, how)
    return cold_part.unionByName(hot_part)


# J2 ------------------------------------------------------------------------
def enrich_submissions(subs: DataFrame, orgs: DataFrame, persons: DataFrame | None = None,
                       org_key: str = "organisation_id", person_key: str = "person_id",
                       hot_rows: int | None = None) -> DataFrame:
    """Submission + organisation (inner) + submitting person (left).

    By default the joins are left to the planner (AQE splits a skewed
    partition). With ``hot_rows`` the organisation join splits hot
    organisations explicitly (``split_hot_join``), for clusters where AQE's
    skew handling is off.
    """
    if hot_rows is None:
        out = subs.join(orgs, org_key, "inner")
    else:
        out = split_hot_join(subs, orgs, org_key, "inner", hot_rows)
    if persons is not None:
        out = out.join(persons, person_key, "left")
    return out


# J3 ------------------------------------------------------------------------
def exists_synced(ids: DataFrame, events: DataFrame, key: str, flag: str = "is_synced") -> DataFrame:
    """One flag per requested id: has it arrived in the event store?"""
    arrived = events.select(key).distinct().withColumn("_hit", F.lit(True))
    return ids.join(arrived, key, "left").select(*ids.columns, fold_flag("_hit").alias(flag))


def synced_only(ids: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Filter form of J3 (semi join)."""
    return ids.join(events.select(key), key, "left_semi").select(*ids.columns)


# J4 ------------------------------------------------------------------------
def exists_both(ids: DataFrame, events: DataFrame, known: DataFrame, key: str,
                flag: str = "is_synchronised") -> DataFrame:
    """Arrived in the event store AND known with the required attribute.

    ``known`` holds the keys that satisfy the second condition; the second
    flag counts only when the first holds (short-circuit order of the checks).
    """
    first = exists_synced(ids, events, key, "_arrived")
    known_keys = known.select(key).distinct().withColumn("_known", F.lit(True))
    both = first.join(known_keys, key, "left")
    return both.select(*ids.columns, (F.col("_arrived") & fold_flag("_known")).alias(flag))


# J5 ------------------------------------------------------------------------
def lookup_period(df: DataFrame, lookup: DataFrame, key: str, actual_col: str,
                  requested_col: str, out: str = "actual_submission_period") -> DataFrame:
    """Stored value for ``key``, falling back to the requested one when absent or null.

    Of several stored values the smallest is taken, so the join is many-to-one
    and keeps the rows of ``df``.
    """
    side = lookup.groupBy(key).agg(F.min(actual_col).alias("_actual"))
    return df.join(side, key, "left").select(
        *df.columns, F.coalesce(F.col("_actual"), F.col(requested_col)).alias(out))
