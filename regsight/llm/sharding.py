"""Sharding by extendible hashing.

A row's place is a string of 63 bits: 40 bits of an md5 of identifier and
text, then 23 bits of a salt that only rows identical up to there ever use. A
bucket is a prefix of those bits; a bucket over the byte limit splits on its
next bit, alone, until each shard fits or holds a single row. The directory
has one entry per shard.

Buckets are weighed without a pass per bit: a histogram at depth d is rolled
up to all shallower depths at once, the shallowest bucket that fits is a
shard, and only rows of buckets that fit at no depth go another ``STEP`` bits
down. Each histogram is a partially aggregated sum, so a hot key costs one
counter.

Defined results: a null text has no bytes; null identifiers hash as the empty
string; a row larger than the limit is a shard of its own; repeated rows are
spread by the salt; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regsight.session import cut_lineage, scratch_path

HASH_BITS, SALT_BITS = 40, 23
BITS = HASH_BITS + SALT_BITS
STEP = 12
MAX_BROADCAST = 200_000  # directory entries, some 100 bytes each
SLOT_SHARDS = 256


def content_hash(id_col, text_col):
    """40 hash bits of a row as a long."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"),
                            F.coalesce(text_col, F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _place(id_col: str, text_col: str):
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << SALT_BITS))
    return F.shiftleft(content_hash(F.col(id_col), F.col(text_col)), SALT_BITS).bitwiseOR(salt)


def _prefix(depth):
    return F.call_function("shiftright", F.col("_place"), (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """Shards (``depth``, ``prefix``, ``shard_bytes``, ``shard_rows``) of rows (_place, _bytes)."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("_bytes"), F.count(F.lit(1))).first()
    if not total[1]:
        return spark.createDataFrame([], "depth int, prefix long, shard_bytes long, shard_rows long")
    start = 0
    deepest = min(BITS, max(1, math.ceil(math.log2(max(1, (total[0] or 0) / limit_bytes)))) + 4)
    shards = None
    while True:
        cells = (rows.groupBy(_prefix(F.lit(deepest)).alias("cell"))
                 .agg(F.sum("_bytes").alias("b"), F.count(F.lit(1)).alias("n")))
        levels = (cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(deepest))))
                  .groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(deepest) - F.col("depth"))
                           .alias("prefix"))
                  .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")))
        path = scratch_path(spark, "shard-levels")
        levels.withColumn("fits", (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_rows") == 1)
                          | (F.col("depth") == BITS)).write.parquet(path)
        levels = spark.read.parquet(path)
        # a bucket exists only if its parent was split
        parent = levels.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"),
                               F.col("fits").alias("whole"))
        alive = levels.withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1))) \
            .join(parent, ["depth", "up"], "left").filter(~F.coalesce(F.col("whole"), F.lit(False)))
        found = alive.filter("fits").select("depth", "prefix", "shard_bytes", "shard_rows")
        shards = found if shards is None else shards.unionByName(found)
        left = levels.filter((F.col("depth") == deepest) & ~F.col("fits")).select("prefix")
        n_left = left.count()
        if not n_left:
            return shards
        rows = rows.withColumn("prefix", _prefix(F.lit(deepest))).join(_small(left, n_left), "prefix", "left_semi") \
            .select("_place", "_bytes")
        start, deepest = deepest + 1, min(BITS, deepest + STEP)


def _look_up(rows: DataFrame, shards: DataFrame, depth: int, n: int) -> DataFrame:
    """``rows`` with the columns of their shards (``n`` of them, ``depth`` bits at most).

    The directory is indexed by as many prefix bits as ``n`` shards need: a
    shallower shard fills several slots, deeper ones share a slot and are told
    apart in it. A slot of more than ``SLOT_SHARDS`` goes to a directory of
    ``STEP`` more bits, with its own rows only.
    """
    spark, done = rows.sparkSession, None
    bits = min(depth, n.bit_length())
    entry = F.struct("depth", "prefix", "shard_bytes", "shard_rows")
    while True:
        wide = shards.withColumn("_slot", F.explode(F.when(
            F.col("depth") <= bits, F.expr(
                f"sequence(shiftleft(prefix, {bits} - depth), "
                f"shiftleft(prefix, {bits} - depth) + (shiftleft(1L, {bits} - depth) - 1))"))
            .otherwise(F.array(F.expr(f"shiftright(prefix, depth - {bits})")))))
        sizes = wide.groupBy("_slot").agg(F.count(F.lit(1)).alias("_many"))
        sizes.write.parquet(path := scratch_path(spark, "shard-slots"))
        sizes = spark.read.parquet(path)
        full = sizes.filter(F.col("_many") > SLOT_SHARDS).select("_slot")
        n_full, n_entries = full.count(), sizes.agg(F.sum("_many")).first()[0] or 0
        rows = rows.withColumn("_slot", _prefix(F.lit(bits)))
        near, fits = rows, wide
        if n_full:
            near, fits = (x.join(_small(full, n_full), "_slot", "left_anti") for x in (rows, wide))
        slots = fits.groupBy("_slot").agg(F.collect_list(entry).alias("_in"))
        own = F.filter("_in", lambda s: F.call_function("shiftright", F.col("_place"), F.lit(BITS) - s["depth"])
                       == s["prefix"])
        found = (near.join(_small(slots, n_entries), "_slot").withColumn("_s", F.element_at(own, 1))
                 .select("*", "_s.*").drop("_slot", "_in", "_s"))
        done = found if done is None else done.unionByName(found)
        if not n_full:
            return done
        rows = rows.join(_small(full, n_full), "_slot", "left_semi").drop("_slot")
        shards = wide.join(_small(full, n_full), "_slot", "left_semi").drop("_slot")
        bits = min(depth, bits + STEP)


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_BROADCAST else df


def shard_documents(docs: DataFrame, limit_bytes: int, *, id_col: str = "doc_id",
                    text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all) plus ``shard`` (the prefix bits as text, ``*``
    for the root), ``depth``, ``n_bytes``, ``shard_bytes`` and ``shard_rows``."""
    added = ["shard", "depth", "n_bytes", "shard_bytes", "shard_rows"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.select(*[F.col(c).alias(f"_c_{c}") for c in kept], _place(id_col, text_col).alias("_place"),
                       size.alias("_bytes"))
    spark = docs.sparkSession

    def weighed(places):
        directory(places, limit_bytes).write.parquet(path := scratch_path(spark, "shard-directory"))
        shards = spark.read.parquet(path)
        return shards, *shards.agg(F.coalesce(F.max("depth"), F.lit(0)), F.count(F.lit(1))).first()

    shards, depth, n = weighed(cut_lineage(rows.select("_place", "_bytes")))
    if depth > HASH_BITS:
        # salts are in use: both passes must see the same ones
        rows.write.parquet(path := scratch_path(spark, "shard-rows"))
        rows = spark.read.parquet(path)
        shards, depth, n = weighed(rows.select("_place", "_bytes"))
    out = _look_up(rows, shards, depth, n)
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(
        F.expr("lpad(conv(cast(prefix as string), 10, 2), depth, '0')"))
    return out.select(*[F.col(f"_c_{c}").alias(c) for c in kept], name.alias("shard"),
                      F.col("depth").cast("int").alias("depth"), F.col("_bytes").alias("n_bytes"),
                      "shard_bytes", "shard_rows")
