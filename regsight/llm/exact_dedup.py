"""Exact deduplication by a distributed content sort.

Normalised texts are range partitioned by sampled splitters and sorted, so
equal texts lie next to each other; Spark's window compares each row's whole
normalised text with its neighbour's and numbers the run. The sort key is
(leading bytes, digest, whole text): splitters stay short however long the
texts are, and the whole text still decides.

A digest of very many rows is spread over ``pieces`` runs by a salt inside the
range key; one row per run then carries its text on, and those few rows are
grouped by whole text. A digest is split from max(``hot_rows``, rows /
``MAX_BROADCAST``) rows on, so the broadcast list of split digests has at most
``MAX_BROADCAST`` entries whatever the input.

Defined results: a null text counts as empty and equals it; of rows tied on
the identifier (repeated rows) exactly one is kept; a null identifier stays
only if its whole group has no other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regsight.session import scratch_path

HOT_ROWS = 2_000
MAX_BROADCAST = 50_000
LEAD_CHARS = 16


def lower_ascii(text):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "smallest", carry: tuple[str, ...] = (),
                 hot_rows: int = HOT_ROWS, pieces: int | None = None) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` and the ``carry`` columns.

    ``keep`` says which identifier of a group stays: "smallest" or "largest".
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, got {keep}")
    largest = keep == "largest"
    spark = docs.sparkSession
    pieces = pieces or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("_id"), lower_ascii(F.col(text_col)).alias("_norm"),
                       *[F.col(c).alias(f"_c_{c}") for c in carry])
    rows = rows.withColumn("_digest", F.sha2("_norm", 256))

    least = max(hot_rows, docs.count() // MAX_BROADCAST)
    hot_path = scratch_path(spark, "hot-digests")
    (rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least)
     .select("_digest").write.parquet(hot_path))
    hot = spark.read.parquet(hot_path).withColumn("_hot", F.lit(True))
    has_hot = not hot.isEmpty()
    if has_hot:
        # row numbers within an input split deal a group evenly over its pieces
        rows = (rows.join(F.broadcast(hot), "_digest", "left")
                .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(),
                                                                  F.lit(pieces))).otherwise(F.lit(0).cast("long"))))

    # the window below finds its rows together: no second exchange of the texts
    place = ["_lead", "_digest", *(["_salt"] if has_hot else [])]
    ranged = rows.withColumn("_lead", F.substring("_norm", 1, LEAD_CHARS)).repartitionByRange(*place)
    order = F.col("_id").desc_nulls_last() if largest else F.col("_id").asc_nulls_last()
    run = Window.partitionBy(*place, "_norm").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (ranged.withColumn("_rn", F.row_number().over(run))
            .withColumn("_keep", F.first("_id").over(whole))
            .withColumn("_size", F.count(F.lit(1)).over(whole)))

    out = [F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
           F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"),
           *[F.col(f"_c_{c}").alias(c) for c in carry]]
    if not has_hot:
        return runs.withColumn("_kept", F.col("_rn") == 1).select(*out)

    path = scratch_path(spark, "content-runs")
    (runs.withColumn("_norm", F.when(F.col("_hot") & (F.col("_rn") == 1), F.col("_norm")))
     .drop("_lead").write.parquet(path))
    runs = spark.read.parquet(path)
    cold = runs.filter(F.col("_hot").isNull()).withColumn("_kept", F.col("_rn") == 1).select(*out)
    heads = runs.filter("_norm is not null")
    first = F.struct(F.col("_keep").isNotNull().alias("a"), F.col("_keep").alias("b"),
                     F.col("_salt").alias("c")) if largest else \
        F.struct(F.col("_keep").isNull().alias("a"), F.col("_keep").alias("b"), F.col("_salt").alias("c"))
    groups = (heads.groupBy("_digest", "_norm")
              .agg((F.max if largest else F.min)(first).alias("_best"), F.sum("_size").alias("_total")))
    merged = (heads.join(groups, ["_digest", "_norm"])
              .select("_digest", "_salt", F.col("_keep").alias("_run"), F.col("_best.b").alias("_keep"),
                      (F.col("_best.c") == F.col("_salt")).alias("_here"),
                      F.col("_total").alias("_size")))
    many = runs.filter("_hot").withColumnRenamed("_keep", "_run").drop("_size").alias("r")
    many = many.join(merged.alias("m"), (F.col("r._digest") == F.col("m._digest"))
                     & (F.col("r._salt") == F.col("m._salt"))
                     & F.col("r._run").eqNullSafe(F.col("m._run")))
    many = many.select("r._id", "m._keep", "m._size", "r._digest", *[f"r._c_{c}" for c in carry],
                       (F.col("m._here") & (F.col("r._rn") == 1)).alias("_kept"))
    return cold.unionByName(many.select(*out))
