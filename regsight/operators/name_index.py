"""F3 by index: trigram posting lists over names, candidates verified by ``contains``.

``write_name_index`` stores which names hold which trigram of their lower-cased form,
clustered by trigram (row groups of other trigrams are skipped), and how many names
hold each. A search looks up the counts of its trigrams, takes the ``RAREST`` of
them, intersects their posting lists and verifies the candidates on the
name itself, so the answer is that of F3. A trigram that few names hold
makes a search small; a common one ("ltd") is not read where a rarer one is there.

A pattern of less than three characters has no trigram: every name is verified, as without an
index. The table is a snapshot of the names it was made from.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
RAREST = 3
TASK_POSTINGS = 1 << 20   # about so many postings are held by one task, however long the list is,
TASK_HITS = 1 << 18       # and so many of a search
POSTINGS, COUNTS, NAMES = "postings", "counts", "names"


def grams(text) -> F.Column:
    """Different trigrams of the lower-cased text; none for shorter texts and null."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    each = F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def write_name_index(df: DataFrame, path: str, id_col: str, name_col: str, num_files: int | None = None) -> str:
    """Store the index of ``name_col`` by ``id_col`` (an id may have several names)."""
    spark = df.sparkSession
    n = num_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = df.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"))
    names.repartitionByRange(n, "id").sortWithinPartitions("id").write.parquet(os.path.join(path, NAMES))
    # a name has fewer trigrams than characters
    names = spark.read.parquet(os.path.join(path, NAMES))
    k = max(n, math.ceil((names.agg(F.sum(F.length("name"))).first()[0] or 0) / TASK_POSTINGS))
    # names of one id meet before the explode, so its postings are told apart where they are made: a task
    # knows its own ids' only, and no posting is shuffled for it
    postings = names.repartitionByRange(k, "id").select(F.explode(grams(F.col("name"))).alias("gram"), "id").distinct()
    # a common trigram spans several files: the range key goes on with the id
    (postings.repartitionByRange(num_files or k, "gram", "id").sortWithinPartitions("gram", "id")
     .write.parquet(os.path.join(path, POSTINGS)))
    (spark.read.parquet(os.path.join(path, POSTINGS)).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
     .repartitionByRange(n, "gram").sortWithinPartitions("gram").write.parquet(os.path.join(path, COUNTS)))
    return path


def search_names(spark: SparkSession, path: str, name: str, rarest: int = RAREST) -> DataFrame:
    """``id`` and ``name`` of the names that contain ``name`` in any case."""
    names = spark.read.parquet(os.path.join(path, NAMES))
    verified = names.filter(F.lower("name").contains(name.lower()))
    low = spark.range(1).select(grams(F.lit(name))).first()[0]      # the rule of the index, not Python's lower()
    if not low:
        return verified
    counts = {r["gram"]: r["n"] for r in spark.read.parquet(os.path.join(path, COUNTS))
              .filter(F.col("gram").isin(low)).collect()}
    if len(counts) < len(low):
        return verified.limit(0)       # a trigram that no name has
    chosen = sorted(counts, key=lambda g: (counts[g], g))[:rarest]
    tasks = math.ceil(sum(counts[g] for g in chosen) / TASK_HITS)
    hits = (spark.read.parquet(os.path.join(path, POSTINGS)).filter(F.col("gram").isin(chosen))
            .repartition(tasks, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(chosen)).select("id"))
    return verified.join(hits, "id", "left_semi")
