"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_rows`` documents. With integer
weights a of total A, block k (from 1) of a source is released at slot
floor((k-1) A / a) and due by slot ceil(k A / a); each slot goes to the
released block of the earliest deadline. Such a schedule keeps every source
within less than one block of its share at every slot, and repeats after A
slots, so one cycle of A entries is all that is scheduled.

No row is dropped: when a source runs out, the remaining ones go on with their
own weights (the next phase, at most one per source), and the bound holds
within each phase. Only row counts per source and partition reach the driver.

A row's ordinal in its source comes from a range partitioning of keys (source,
hash of the identifier, hashes of the row): partitions are contiguous, so the
ordinal is the place in the partition plus the rows of the source before it. A
hot source spans many partitions and is never windowed. Rows that have been mixed
and stored can keep the order they are stored in instead (``stored_places``). Only keys are ranged
and written; the rows are joined to their places at the end, one of equal rows to
all of theirs.

Defined results: a null source is a source of its own; repeated rows take
consecutive ordinals; rows of one identifier (null is one) go by 128 hash bits of
their kept columns, so the schedule does not depend on how rows are stored; an empty table gives no
rows; a source without a given weight, or of weight 0, comes after all others.
"""

from __future__ import annotations

import heapq
import math
import re
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regsight.llm.text import numbered
from regsight.session import scratch_path

BLOCK_ROWS = 64
MAX_SOURCES = 1_000   # a target weight per source is a setting; group more sources than this
RESOLUTION = 1_000     # weights that follow from row counts are integers of about this total
MAX_CYCLE = 100_000  # given shares are kept exactly up to this many slots a cycle


def cycle(weights: list[int]) -> list[int]:
    """Source index per slot over one cycle of sum(weights) slots."""
    total = sum(weights)
    released: dict[int, list[int]] = {}
    for i in range(len(weights)):
        released.setdefault(0, []).append(i)
    done, ready, out = [0] * len(weights), [], []
    for slot in range(total):
        for i in released.pop(slot, ()):
            due = -(-(done[i] + 1) * total // weights[i])
            heapq.heappush(ready, (due, i))
        _, i = heapq.heappop(ready)
        out.append(i)
        done[i] += 1
        if done[i] < weights[i]:
            released.setdefault(max(slot + 1, done[i] * total // weights[i]), []).append(i)
    return out


def phases(blocks: dict, weights: dict) -> list[tuple]:
    """(source, phase, first block, first slot, cycle length, slots of a cycle, weight) rows.

    A phase lasts until a source has no block left; within it, block ``first +
    c * w + j`` of a source stands at slot ``first slot + c * length + slots[j]``.
    """
    left = {s: n for s, n in blocks.items() if n}
    used = dict.fromkeys(left, 0)
    out, slot, phase = [], 0, 0
    while left:
        # a source of weight 0 waits until the others have run out
        weights = weights if any(weights[s] for s in left) else dict.fromkeys(left, 1)
        names = sorted((s for s in left if weights[s]), key=lambda s: (s is not None, s))
        order = cycle([weights[s] for s in names])
        own: dict = {s: [] for s in names}
        for at, i in enumerate(order):
            own[names[i]].append(at)
        length = len(order)
        # the slot after the last block of the source that runs out first
        end = min((left[s] - 1) // weights[s] * length + own[s][(left[s] - 1) % weights[s]] + 1
                  for s in names)
        for s in names:
            out.append((s, phase, used[s], slot, length, own[s], weights[s]))
            took = end // length * weights[s] + sum(at < end % length for at in own[s])
            used[s] += took
            left[s] -= took
        left = {s: n for s, n in left.items() if n}
        slot += end
        phase += 1
    return out


def integer_weights(counts: dict, targets: dict | None, resolution: int = RESOLUTION) -> dict:
    """Integer weights in exactly the given shares, or by the square root of the size.

    A share is read as the decimal number it is written as. Shares whose exact
    cycle would be longer than ``MAX_CYCLE`` slots are refused.
    """
    if targets is None:
        total = sum(n ** 0.5 for n in counts.values()) or 1
        return {s: max(1, round(n ** 0.5 / total * resolution)) for s, n in counts.items()}
    shares = {s: Fraction(str(targets.get(s, 0))) for s in counts}
    if any(w < 0 for w in shares.values()):
        raise ValueError("a target weight is negative")
    whole = math.lcm(*[w.denominator for w in shares.values()]) if shares else 1
    weights = {s: int(w * whole) for s, w in shares.items()}
    least = math.gcd(*weights.values()) or 1
    weights = {s: w // least for s, w in weights.items()}
    if sum(weights.values()) > MAX_CYCLE:
        raise ValueError(f"the shares need a cycle of {sum(weights.values())} slots; round them to at most {MAX_CYCLE}")
    return weights


def mix_sources(docs: DataFrame, targets: dict | None = None, *, id_col: str = "doc_id",
                source_col: str = "source", block_rows: int = BLOCK_ROWS,
                resolution: int = RESOLUTION, keep: list[str] | None = None,
                tie_cols: list[str] | None = None, order_cols: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) plus ``block``, ``slot``, ``place`` (in the
    block), ``release``, ``deadline`` (slots) and ``phase``. Order by (slot, place).

    ``targets`` maps sources to shares, which are kept exactly; without it a source's
    share follows the square root of its number of rows. Rows of one identifier are
    ordered by a hash of ``tie_cols`` (default: the kept columns). With ``order_cols``
    the rows of a source go in the order of those columns.
    """
    spark = docs.sparkSession
    added = ["block", "slot", "place", "release", "deadline", "phase"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    def hashed(seed, columns):
        # a null cell takes no part in a hash: its place is hashed beside it
        nulls = F.concat_ws("", *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
        return F.xxhash64(F.lit(seed), nulls, *[
            F.to_json(F.struct(c)) if re.search("map<|variant", docs.schema[c].dataType.simpleString()) else F.col(c)
            for c in columns])

    whole = list(dict.fromkeys([*kept, id_col, source_col]))
    key = ["_h", "_r", "_q"]       # says which row it is, its source included
    rows = docs.select(*[F.col(c).alias(f"_c_{c}") for c in kept], F.col(source_col).alias("_s"),
                       F.xxhash64(F.col(id_col)).alias("_h"), hashed(0, kept if tie_cols is None else tie_cols).alias("_o"),
                       hashed(1, whole).alias("_r"), hashed(2, whole).alias("_q"),
                       *[F.col(c).alias(f"_by{i}") for i, c in enumerate(order_cols or [])])
    by = [f"_by{i}" for i in range(len(order_cols or []))]
    path = scratch_path(spark, "mix-ranged")
    # _m only parts equal rows, which take each other's place
    order = ["_s", *by, "_h", "_o", "_r", "_q", "_m"]
    (rows.select("_s", "_o", *by, *key, F.monotonically_increasing_id().alias("_m"))
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumn("_at", F.monotonically_increasing_id()).drop("_m", "_o", *by).write.parquet(path))
    ranged = spark.read.parquet(path).withColumn("_p", F.shiftright("_at", 33))
    # rows of a source in a partition are contiguous; partitions x sources that meet there
    parts = ranged.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low"))
    got = parts.collect()
    counts: dict = {}
    for r in got:
        counts[r["_s"]] = counts.get(r["_s"], 0) + r["n"]
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"{len(counts)} sources; group them into at most {MAX_SOURCES}")
    before, base = {}, []
    for r in sorted(got, key=lambda r: r["_p"]):
        base.append((r["_s"], r["_p"], before.get(r["_s"], 0) - r["low"]))
        before[r["_s"]] = before.get(r["_s"], 0) + r["n"]
    weights = integer_weights(counts, targets, resolution)
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, weights)
    kind = docs.schema[source_col].dataType.simpleString()
    base_df = spark.createDataFrame(base, f"s {kind}, p long, base long")
    steps: dict = {}
    for s, phase, first, slot, length, own, weight in plan:
        steps.setdefault(s, []).append((phase, first, slot, length, weight, own))
    plan_df = spark.createDataFrame(
        list(steps.items()), f"ps {kind}, steps array<struct<phase:int,first:long,slot:long,length:int,"
                             "weight:int,slots:array<int>>>")
    out = (ranged.join(F.broadcast(base_df), F.col("_s").eqNullSafe(F.col("s")) & (F.col("_p") == F.col("p")))
           .withColumn("_ord", F.col("_at") + F.col("base"))
           .withColumn("block", F.floor(F.col("_ord") / block_rows))
           .join(F.broadcast(plan_df), F.col("_s").eqNullSafe(F.col("ps")))
           .withColumn("_t", F.element_at(F.filter("steps", lambda x: x["first"] <= F.col("block")), -1))
           .withColumn("_k", F.col("block") - F.col("_t.first")))
    # the rows are dealt by their key once, for both the choice of one of equal rows and the join
    out = out.join(rows.drop("_s", "_o", *by).dropDuplicates(key), key)
    t = "_t."
    turn = F.expr("_k div _t.weight")
    within = F.element_at(F.col(t + "slots"), (F.col("_k") % F.col(t + "weight") + 1).cast("int"))
    return out.select(
        *[F.col(f"_c_{c}").alias(c) for c in kept], F.col("block").cast("long").alias("block"),
        (F.col(t + "slot") + turn * F.col(t + "length") + within).alias("slot"),
        (F.col("_ord") % block_rows).cast("int").alias("place"),
        (F.col(t + "slot") + F.expr("_k * _t.length div _t.weight")).alias("release"),
        (F.col(t + "slot") + F.expr("((_k + 1) * _t.length + _t.weight - 1) div _t.weight")).alias("deadline"),
        F.col(t + "phase").alias("phase"))


def mix_in_order(docs: DataFrame, targets: dict | None = None, *, id_col: str = "doc_id",
                 source_col: str = "source", **options) -> DataFrame:
    """The documents in the order of the schedule, columns unchanged."""
    plain, own = numbered(docs)
    out = mix_sources(plain, targets, id_col=own[id_col], source_col=own[source_col], **options)
    return out.orderBy("slot", "place").select(*[F.col(c).alias(name) for name, c in own.items()])


def stored_places(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with the place at which each is stored, and the columns that say it; none where rows are not read from files.

    Spark numbers the files of a sorted table in its order; a file's rows are numbered as they lie in it,
    however a reader splits or packs the files.
    """
    at = {"_stored_part": r"try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) AS BIGINT)",
          "_stored_file": "_metadata.file_path", "_stored_row": "_metadata.row_index"}
    try:
        return docs.select("*", *[F.expr(e).alias(c) for c, e in at.items()]), list(at)
    except AnalysisException:
        return docs, []


def with_schedule(docs: DataFrame, targets: dict | None = None, *, id_col: str = "doc_id",
                  source_col: str = "source", tie_cols: list[str] | None = None,
                  order_cols: list[str] | None = None, **options) -> DataFrame:
    """The documents with ``slot`` and ``place``, whatever their order is now, or, with ``order_cols``,
    in the order of these columns within each source."""
    plain, own = numbered(docs)
    tie = None if tie_cols is None else [own[c] for c in tie_cols]
    out = mix_sources(plain, targets, id_col=own[id_col], source_col=own[source_col], tie_cols=tie,
                      order_cols=[own[c] for c in order_cols or []], **options)
    return out.select(*[F.col(c).alias(name) for name, c in own.items()], "slot", "place")
