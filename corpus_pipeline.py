"""A training-corpus pipeline over ``documents``.

Each stage gets what its predecessor kept, read back from Parquet, and all but
the last return the columns of documents. What the mixing stage decides is the
order of its rows, and it is stored as that: files are numbered in it, and rows
within a file. The last stage takes each row's stored place along and returns
the schedule of that order, ``slot`` and ``place``, which a hash into shards would
lose; a shard's rows are read in that order. Sharding keeps every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regsight.llm import decontaminate, language_id, mixing, near_dedup, sharding
from regsight.llm.catalog import SHARD_LIMIT, held_out, prepare, table
from regsight.session import scratch_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are too far from every language or have no letter."""
    prepare(spark)
    return language_id.drop_rejected(docs, ~held_out(4))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    prepare(spark)
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    prepare(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Order the documents by the schedule that interleaves their sources."""
    prepare(spark)
    return mixing.mix_in_order(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document its shard and its ``slot`` and ``place`` in the mixing schedule.

    The rows of a source keep the order in which the stage before has stored them; rows
    that are not read from files take the order that stage would give them.
    """
    prepare(spark)
    stored, order = mixing.stored_places(docs)
    shards = sharding.shard_documents(stored, SHARD_LIMIT)
    return mixing.with_schedule(shards, tie_cols=docs.columns, order_cols=order).drop(*order)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: Near duplicates and the trained language model have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
