"""Incremental A1 / J3 over event files as the sync jobs land them.

The event store is appended to by synchronisation jobs. Instead of scanning
the whole table for every question, a Structured Streaming query keeps

* the latest load timestamp (A1), and
* the first and latest load time per submission id (J3's "has it arrived"),

in Spark state, with its progress in a checkpoint under the shared
``spark.checkpoint.dir``. Both aggregates are algebraic, so state holds one
row per key and a hot submission is reduced map-side in every micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regsight.sources.tables import SUBMISSION_EVENT_SCAN_SCHEMA


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming scan of event parquet files (declared schema, as S1).

    ``path`` is the landing folder or a glob of files in it.
    """
    reader = spark.readStream.schema(SUBMISSION_EVENT_SCAN_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path).withColumnRenamed("ts", "load_ts")


def last_sync_time_stream(events: DataFrame) -> DataFrame:
    """A1 as a running aggregate (one row, complete mode)."""
    return events.agg(F.max("load_ts").alias("last_sync_time"))


def arrivals_stream(events: DataFrame) -> DataFrame:
    """Per submission id: first and latest load time (update mode)."""
    return (events.groupBy(F.col("user_id").alias("submission_id"))
            .agg(F.min("load_ts").alias("first_loaded"), F.max("load_ts").alias("last_loaded")))


def start_monitor(spark: SparkSession, path: str, checkpoint: str, sink_name: str = "last_sync_time",
                  available_now: bool = True) -> StreamingQuery:
    """Start the A1 monitor into a memory table named ``sink_name``.

    ``checkpoint`` is a folder that stays from run to run: a run goes on where the last one ended.
    ``available_now`` processes what has landed and stops (batch-like runs
    under a scheduler); otherwise it runs continuously.
    """
    query = (last_sync_time_stream(event_stream(spark, path))
             .writeStream.outputMode("complete").format("memory").queryName(sink_name)
             .option("checkpointLocation", checkpoint))
    query = query.trigger(availableNow=True) if available_now else query
    return query.start()


def write_arrivals(spark: SparkSession, path: str, out_path: str, checkpoint: str,
                   available_now: bool = True) -> StreamingQuery:
    """Maintain the arrivals table: each micro-batch appends its changed keys.

    ``checkpoint`` is a folder that stays from run to run. Readers take ``max(last_loaded)`` per submission id (J3 only asks whether
    a row exists, so repeated keys across batches are harmless).
    """
    def sink(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("append").parquet(out_path)

    query = (arrivals_stream(event_stream(spark, path))
             .writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", checkpoint))
    query = query.trigger(availableNow=True) if available_now else query
    return query.start()
