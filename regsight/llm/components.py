"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regsight.session import drop_scratch, scratch_path


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for edges (``u``, ``v``).

    Every step is an aggregation and an equality join over the edges. Minima
    combine before the shuffle; the joins are many-to-one, and a hub's edges
    go to one task unless AQE splits them. Each round is written to the shared
    folder and read back, and the round before it is removed.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) \
        .filter(F.col("u") != F.col("v"))
    before = last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u") \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        path = scratch_path(spark, "components")
        small.write.parquet(path)
        now = spark.read.parquet(path)
        if last:
            drop_scratch(spark, last)
        last = path
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 31)),
                        F.sum((F.xxhash64("v", "u") % (1 << 31)))).first()
        if state == before or not state[0]:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")) \
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
