"""Joins, aggregations, windows and paging, projections."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from regsight.operators import aggregate as A
from regsight.operators import joins as J
from regsight.operators import paging as W
from regsight.operators import project as PR


# J ---------------------------------------------------------------------------
def test_bounded_broadcast(spark):
    assert J.has_at_most(spark.range(5), 10) and not J.has_at_most(spark.range(50), 10)
    big = spark.range(50)
    assert J.bounded_broadcast(big, 10) is big
    small = J.bounded_broadcast(spark.range(5).withColumnRenamed("id", "k"), 10)
    fact = spark.range(1000).withColumnRenamed("id", "k")
    plan = fact.join(small, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # the bound may come from a larger frame (input before de-duplication)
    few = big.limit(5)
    assert J.bounded_broadcast(few, 10, bound_from=big) is few
    assert J.bounded_broadcast(few, 10, bound_from=spark.range(8)) is not few


def test_overlay_last_entry_wins_and_unmatched_ignored(spark):
    stored = spark.createDataFrame([("f1", "Pending", "c1"), ("f2", "Accepted", "c2")],
                                   "file_id string, decision string, comments string")
    delta = spark.createDataFrame([("f1", "Rejected", None, 1), ("f1", "Accepted", "late", 2),
                                   ("f9", "Rejected", "x", 3)],
                                  "file_id string, decision string, comments string, pos int")
    out = J.overlay_decisions(stored, delta, "file_id", ["decision", "comments"], ["pos"])
    got = sorted(tuple(r) for r in out.collect())
    assert got == [("f1", "Accepted", "late"), ("f2", "Accepted", "c2")]


def test_exists_synced_and_both(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    events = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    known = spark.createDataFrame([("a",), ("c",)], "k string")
    assert J.exists_synced(ids.select(F.lit(1).alias("x"), "k"), events, "k").columns == \
        ["x", "k", "is_synced"]
    got = dict((r.k, r.is_synced) for r in J.exists_synced(ids, events, "k").collect())
    assert got == {"a": True, "b": True, "c": False}
    both = dict((r.k, r.is_synchronised) for r in J.exists_both(ids, events, known, "k").collect())
    assert both == {"a": True, "b": False, "c": False}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_hot_join_equals_plain_join(spark, how):
    big = spark.createDataFrame([(0 if i % 3 else i % 7, i) for i in range(300)], "k int, v int")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "k int, name string")
    plain = sorted(tuple(r) for r in big.join(small, "k", how).select("k", "v", "name").collect())
    for hot_rows in (10, 10 ** 6):
        split = J.split_hot_join(big, small, "k", how, hot_rows=hot_rows).select("k", "v", "name")
        assert sorted(tuple(r) for r in split.collect()) == plain


def test_enrich_with_hot_split(spark, sf_small):
    from regsight.sources import standin as V
    subs, orgs = V.submissions(spark, sf_small), V.organisations(spark, sf_small)
    cols = ["submission_id", "organisation_name", "nation_id"]
    plain = sorted(tuple(r) for r in J.enrich_submissions(subs, orgs).select(*cols).collect())
    split = J.enrich_submissions(subs, orgs, hot_rows=5).select(*cols)
    assert sorted(tuple(r) for r in split.collect()) == plain


def test_synced_only_filter_form(spark):
    ids = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    events = spark.createDataFrame([("a",), ("a",), ("c",), ("z",)], "k string")
    got = J.synced_only(ids, events, "k")
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 1), ("c", 3)]
    assert got.columns == ["k", "v"]


def test_lookup_period_fallback(spark):
    req = spark.createDataFrame([("s1", "July to December 2025"), ("s2", "July to December 2025"),
                                 ("s3", "January to June 2025")], "k string, requested string")
    stored = spark.createDataFrame([("s1", "January to December 2025"), ("s2", None)],
                                   "k string, actual string")
    out = dict((r.k, r.actual_submission_period)
               for r in J.lookup_period(req, stored, "k", "actual", "requested").collect())
    assert out == {"s1": "January to December 2025", "s2": "July to December 2025",
                   "s3": "January to June 2025"}


# A ---------------------------------------------------------------------------
def test_max_sync_time_and_empty(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1),), (dt.datetime(2025, 1, 2),)],
                               "load_ts timestamp_ntz")
    assert A.last_sync_time_value(df) == dt.datetime(2025, 1, 2)
    with pytest.raises(ValueError):
        A.last_sync_time_value(df.limit(0))


def test_approved_weights_exact_then_truncate(spark):
    rows = [("2024-P1", "AL", 1, 7, "DR", 0.1), ("2024-P1", "AL", 1, 7, "DR", 0.2),
            ("2024-P1", "AL", 1, 7, "DR", 2.65)]
    df = spark.createDataFrame(rows, "submission_period string, packaging_material string, "
                                     "organisation_id bigint, submitter_id bigint, submitter_type string, "
                                     "packaging_material_weight double")
    row = A.approved_weights(df).first()
    assert row.packaging_material_weight == 2 and row.number_of_days_obligated is None


def test_approved_weights_by_year_null_key(spark):
    rows = [("p", "AL", 1, 1, "DR", 1.0, None), ("p", "AL", 1, 1, "DR", 2.0, None),
            ("p", "AL", 1, 1, "DR", 4.0, 10)]
    df = spark.createDataFrame(rows, "submission_period string, packaging_material string, "
                                     "organisation_id bigint, submitter_id bigint, submitter_type string, "
                                     "packaging_material_weight double, number_of_days_obligated int")
    got = sorted((r.number_of_days_obligated or -1, r.packaging_material_weight)
                 for r in A.approved_weights_by_year(df).collect())
    assert got == [(-1, 3), (10, 4)]


def test_fee_counts(spark):
    rows = [("f", 1, 10, True, False), ("f", 1, 10, False, False), ("f", 1, 11, False, True),
            ("f", 1, 12, True, True), ("f", 2, 10, False, False)]
    df = spark.createDataFrame(rows, "file_id string, org int, sub int, onl boolean, clr boolean")
    out = {r.org: (r.number_of_subsidiaries, r.online, r.closed)
           for r in A.fee_counts(df, ["file_id", "org"], "sub", {"online": "onl", "closed": "clr"},
                                 {}).collect()}
    assert out == {1: (3, 2, 2), 2: (1, 0, 0)}


def test_half_year_flags(spark):
    df = spark.createDataFrame([(1, "2025-H1"), (1, "2025-H1"), (2, "2025-H2"), (3, "2024-P1")],
                               "org int, submission_period string")
    out = {r.org: (r.has_h1, r.has_h2) for r in A.half_year_flags(df, ["org"]).collect()}
    assert out == {1: (True, False), 2: (False, True), 3: (False, False)}


# W / L -------------------------------------------------------------------------
def _plain_history(df):
    w = Window.partitionBy("org", "yr").orderBy("ts", "id")
    rc = F.when(F.col("status") == "Rejected", F.col("comments"))
    return df.select("id", (F.row_number().over(w) > 1).alias("is_resubmission"),
                     F.lag(rc).over(w).alias("previous_rejection_comments"))


def test_resubmission_history_hot_group_matches_plain_window(spark):
    # one organisation holds most rows, so it spans several range pieces
    rows = []
    for i in range(400):
        org = 1 if i % 10 else 2 + i % 3
        status = "Rejected" if i % 3 == 0 else "Accepted"
        rows.append((i, org, 2025 + (i % 2), dt.datetime(2025, 1, 1) + dt.timedelta(hours=i),
                     status, f"c{i}"))
    df = spark.createDataFrame(rows, "id int, org int, yr int, ts timestamp_ntz, status string, "
                                     "comments string")
    ref = sorted(tuple(r) for r in _plain_history(df).collect())
    # hot_rows=50: organisation 1 (360 rows) takes the split path, the others the plain window
    for hot_rows in (50, 0, 10 ** 6):
        got = W.resubmission_history(df, ["org", "yr"], ["ts", "id"], "status", "comments",
                                     num_pieces=6, hot_rows=hot_rows)
        mine = sorted((r.id, r.is_resubmission, r.previous_rejection_comments)
                      for r in got.select("id", "is_resubmission", "previous_rejection_comments").collect())
        assert mine == ref
        assert got.count() == 400
        assert got.columns == [*df.columns, "is_resubmission", "previous_rejection_comments"]


def test_split_history_alone_matches_plain_window(spark):
    rows = [(i, 1, 2025, dt.datetime(2025, 1, 1) + dt.timedelta(minutes=i),
             "Rejected" if i % 4 == 0 else "Accepted", f"c{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, org int, yr int, ts timestamp_ntz, status string, "
                                     "comments string")
    got = W.split_history(df, ["org", "yr"], ["ts", "id"], "status", "comments", num_pieces=8)
    mine = sorted((r.id, r.is_resubmission, r.previous_rejection_comments)
                  for r in got.select("id", "is_resubmission", "previous_rejection_comments").collect())
    assert mine == sorted(tuple(r) for r in _plain_history(df).collect())


def test_with_total_items(spark):
    df = spark.range(7)
    assert {r.total_items for r in W.with_total_items(df).collect()} == {7}


def test_page_plain_and_past_end(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    page = W.page_plain(df, ["k"], 2, 10)
    assert [r.k for r in page.items.collect()] == list(range(10, 20))
    assert page.current_page == 2 and page.total_items() == 100
    past = W.page_plain(df, ["k"], 11, 10)
    assert past.items.count() == 0 and past.total_items() == 0 and past.current_page == 11


@pytest.mark.parametrize("total,size,page,expected", [(100, 20, 4, 4), (30, 20, 4, 2), (0, 20, 4, 1),
                                                      (0, 20, 1, 1), (30, 20, 0, 1)])
def test_clamp_page(total, size, page, expected):
    assert W.clamp_page(page, size, total) == expected


def test_page_clamped_fetches_last_page(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    page = W.page_clamped(df, ["k"], 4, 20)
    assert page.current_page == 2 and page.total_items() == 30
    assert [r.k for r in page.items.collect()] == list(range(20, 30))


@pytest.mark.parametrize("page,size", [(1, 7), (3, 7), (14, 7), (15, 7), (40, 3)])
def test_deep_page_path_equals_shallow(spark, page, size):
    df = spark.createDataFrame([(i % 9, i) for i in range(100)], "g int, id int")
    order = [F.col("g").desc(), F.col("id").asc()]
    shallow = [tuple(r) for r in W.page_rows(df, order, page, size).collect()]
    deep = [tuple(r) for r in W.page_rows(df, order, page, size, deep_threshold=0).collect()]
    assert deep == shallow
    wide = df.withColumn("payload", F.concat(F.lit("p"), F.col("id").cast("string")))
    narrow = W.page_rows(wide, order, page, size, deep_threshold=0, key_cols=["g", "id"])
    assert narrow.columns == wide.columns
    assert [(r.g, r.id) for r in narrow.collect()] == shallow


def test_page_clamped_deep(spark):
    df = spark.range(95).withColumnRenamed("id", "k")
    page = W.page_clamped(df, ["k"], 1000, 10, deep_threshold=0)
    assert page.current_page == 10 and [r.k for r in page.items.collect()] == list(range(90, 95))


def test_page_size_zero_rejected(spark):
    with pytest.raises(ValueError):
        W.page_plain(spark.range(3), ["id"], 1, 0)


def test_first_or_none_and_per_key(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 9, "z")], "k int, o int, v string")
    assert W.first_or_none(df, ["o"]).first().v == "a"
    assert W.first_or_none(df.limit(0), ["o"]).first() is None
    got = sorted(tuple(r) for r in W.first_per_key(df, "k", ["o"]).collect())
    assert got == [(1, 3, "a"), (2, 9, "z")]


# P ---------------------------------------------------------------------------
def test_project_pom_requires_organisation(spark):
    cols = ", ".join(f"{c} string" for c in PR.POM_EXTRACT_COLUMNS if c != "organisation_id")
    df = spark.createDataFrame([tuple([None] * 11) + (None,)],
                               f"{cols}, organisation_id int")
    with pytest.raises(Exception, match="organisation_id is null"):
        PR.project_pom(df).collect()


def test_decode_decisions_null_empty_and_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "[]"), (3, ""), (4, '[{"FileId":"f","Decision":"Accepted",'
                                                                '"Comments":"ok","IsResubmissionRequired":true}]')],
                               "id int, d string")
    out = PR.decode_decisions(df, "d", keep=("id",)).collect()
    assert [(r.id, r.FileId, r.Decision, r.IsResubmissionRequired) for r in out] == [(4, "f", "Accepted", True)]


def test_encode_decisions_round_trip(spark):
    df = spark.createDataFrame([("f", "Rejected", None, False)],
                               "FileId string, Decision string, Comments string, IsResubmissionRequired boolean")
    text = df.select(PR.encode_decisions(["FileId", "Decision", "Comments", "IsResubmissionRequired"])
                     .alias("d"))
    assert text.first().d == '[{"FileId":"f","Decision":"Rejected","IsResubmissionRequired":false}]'
    assert PR.decode_decisions(text, "d").first().Decision == "Rejected"
