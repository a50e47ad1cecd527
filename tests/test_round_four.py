"""Findings of the third review: whole inputs, and figures that do not grow with a list."""

import datetime as dt

from pyspark.sql import functions as F

from regsight.operators import filters as FL
from regsight.operators import name_index as NI
from regsight.operators import page_directory as PD
from regsight.plans import catalog
from regsight.plans import sql_functions as SQ
from regsight.session import scratch_path
from regsight.sources import standin as V


def test_max_sync_time_reads_every_event(spark, tmp_path):
    # the latest event is none that carries a decision
    rows = [(1, dt.datetime(2025, 1, 1), 7, "purchase", 1.0, "{}"), (2, dt.datetime(2025, 1, 3), 7, "view", 1.0, "{}"),
            (3, dt.datetime(2025, 1, 2), 8, "error", 1.0, "{}"), (4, None, None, None, None, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
                                "props string").write.parquet(str(tmp_path / "events.parquet"))
    out = catalog.QUERIES["max_sync_time"](spark, str(tmp_path))
    assert [r.last_sync_time for r in out.collect()] == [dt.datetime(2025, 1, 3)]


def test_postings_are_spread_however_long_the_list(spark, monkeypatch):
    monkeypatch.setattr(NI, "TASK_POSTINGS", 200)
    monkeypatch.setattr(NI, "TASK_HITS", 50)
    rows = [(i, f"Common Ltd {i:04d}") for i in range(400)] + [(7, "Common Ltd again"), (7, "Common Ltd again"),
                                                              (None, "Common none"), (None, "none"), (8, None)]
    df = spark.createDataFrame(rows, "id long, name string")
    path = NI.write_name_index(df.coalesce(1), scratch_path(spark, "t-spread"), "id", "name")
    postings = spark.read.parquet(path + "/" + NI.POSTINGS)
    files = postings.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 16 and max(r["count"] for r in files) < postings.count() / 8
    assert postings.count() == postings.distinct().count()
    held = {r.gram: r.n for r in spark.read.parquet(path + "/" + NI.COUNTS).collect()}
    assert held["com"] == 401 and held["aga"] == 1 and held["one"] == 1
    # a null id matches no posting, as before
    for pattern in ("common", "ltd 0123", "again"):
        got = sorted(tuple(r) for r in NI.search_names(spark, path, pattern).collect())
        assert got == sorted(tuple(r) for r in FL.filter_name(df.filter("id IS NOT NULL"), "name", pattern).collect())


def test_ranges_of_a_long_list_hold_more_rows(spark, monkeypatch):
    monkeypatch.setattr(PD, "MANY_RANGES", 10)
    df, order = spark.range(500).select("id", (F.col("id") % 3).alias("a")), [F.col("a").desc(), F.col("id").asc()]
    path = scratch_path(spark, "t-many")
    made = PD.write_directory(df, path, order, range_rows=2)
    assert made.ranges == 10 and made.total == 500
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    for page in (1, 13, 72):
        rows = PD.directory_page(spark, made, order, page, 7).items.collect()
        assert [tuple(r)[:2] for r in rows] == want[(page - 1) * 7:page * 7]


def test_members_are_told_apart_in_tasks_of_bounded_size(spark, sf_small, monkeypatch):
    query = "SELECT * FROM organisation_registration_details()"
    want = sorted(map(str, SQ.call(spark, sf_small, query).collect()))
    monkeypatch.setattr(V, "TASK_LINES", 500)
    out = SQ.call(spark, sf_small, query)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, out.collect())) == want
