"""Incremental A1/J3 give the same answers as the batch operators."""

import os

from pyspark.sql import functions as F

from regsight.operators import aggregate as A
from regsight.session import scratch_path
from regsight.sources import standin as V
from regsight.streaming import sync_monitor as S


def test_stream_last_sync_time_equals_batch(spark, sf_small):
    q = S.start_monitor(spark, os.path.join(sf_small, "events*.parquet"),
                        scratch_path(spark, "t-last-ckpt"), sink_name="t_last_sync")
    q.awaitTermination(120)
    got = spark.sql("SELECT last_sync_time FROM t_last_sync").first()[0]
    assert got == A.last_sync_time_value(V.submission_events(spark, sf_small))


def test_stream_arrivals_equal_batch_distinct(spark, sf_small):
    out = scratch_path(spark, "t-arrivals")
    q = S.write_arrivals(spark, os.path.join(sf_small, "events*.parquet"), out, scratch_path(spark, "t-arr-ckpt"))
    q.awaitTermination(120)
    streamed = {r.submission_id for r in spark.read.parquet(out).select("submission_id").collect()}
    batch = {r.submission_id for r in V.submission_events(spark, sf_small)
             .select("submission_id").distinct().collect()}
    assert streamed == batch


def test_incremental_batches(spark, sf_small):
    """Two landings: state after each equals the batch answer over what has landed."""
    landing = scratch_path(spark, "t-landing")
    events = spark.read.parquet(os.path.join(sf_small, "events.parquet"))
    cut = events.approxQuantile("event_id", [0.5], 0.0)[0]
    first, second = events.filter(F.col("event_id") <= cut), events.filter(F.col("event_id") > cut)
    first.write.parquet(os.path.join(landing, "part1"))
    checkpoint = scratch_path(spark, "t-landing-ckpt")
    source = os.path.join(landing, "*")
    out = scratch_path(spark, "t-landing-arrivals")

    def run():
        S.start_monitor(spark, source, sink_name="t_incr", checkpoint=checkpoint).awaitTermination(120)
        S.write_arrivals(spark, source, out, checkpoint=checkpoint + "-arr").awaitTermination(120)
        last = spark.sql("SELECT last_sync_time FROM t_incr").first()[0]
        ids = {r.submission_id for r in spark.read.parquet(out).select("submission_id").collect()}
        return last, ids

    last, ids = run()
    assert last == first.agg(F.max("ts")).first()[0]
    assert ids == {r.user_id for r in first.select("user_id").distinct().collect()}
    second.write.parquet(os.path.join(landing, "part2"))
    last, ids = run()
    assert last == events.agg(F.max("ts")).first()[0]
    assert ids == {r.user_id for r in events.select("user_id").distinct().collect()}
