"""Rejects inside a report, the bucketed layout, point lookups and corrected reports."""

import datetime as dt
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regsight.functions import normalise as N
from regsight.operators import aggregate as A
from regsight.operators import joins as J
from regsight.plans import api
from regsight.plans import reports as R
from regsight.session import scratch_path
from regsight.sources import layout as LY
from regsight.sources import standin as V

TARGET = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("n", T.IntegerType(), False),
                       T.StructField("flag", T.BooleanType(), False), T.StructField("at", T.TimestampNTZType()),
                       T.StructField("gone", T.StringType())])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# N6 + S2 -------------------------------------------------------------------
DIRTY = [(1, "7", "true", "2025-01-01 10:00:00"), (2, "x", "perhaps", "never"), (3, None, None, None),
         (4, "", "no", "2025-02-30"), (5, "3000000000", "1", "2025-01-01")]


def dirty(spark):
    return spark.createDataFrame(DIRTY, "id long, N string, flag string, at string")


def test_rejects_are_counted_by_the_pass_that_aligns(spark):
    seen = Observation()
    out = N.align_schema(dirty(spark), TARGET, rejects=seen)
    got = {r.id: (r.n, r.flag, r["at"], r.gone) for r in out.collect()}
    assert got == {1: (7, True, dt.datetime(2025, 1, 1, 10), None), 2: (0, False, None, None),
                   3: (0, False, None, None), 4: (0, False, None, None), 5: (0, True, dt.datetime(2025, 1, 1), None)}
    assert seen.get == {"rows": 5, "n": 3, "flag": 1, "at": 2}


def test_reject_rows_name_the_cells(spark):
    got = rows(N.reject_rows(dirty(spark), TARGET, ["id"]))
    assert got == [(2, "at", "never"), (2, "flag", "perhaps"), (2, "n", "x"), (4, "at", "2025-02-30"), (4, "n", ""),
                   (5, "n", "3000000000")]
    assert "Exchange" not in plan(N.reject_rows(dirty(spark), TARGET, ["id"]))
    clean = spark.createDataFrame([(1, 2, True)], "id long, n int, flag boolean")
    assert N.reject_rows(clean, TARGET, ["id"]).collect() == []


def test_report_on_dirty_input_keeps_rows_and_counts(spark, sf_small):
    delivered, seen = V.organisations_delivered(spark, sf_small), Observation()
    out = R.organisation_registration_detail(spark, sf_small, organisations=delivered, rejects=seen)
    got = {r.submission_id: r for r in out.collect()}
    clean = {r.submission_id: r for r in R.organisation_registration_detail(spark, sf_small).collect()}
    assert got.keys() == clean.keys()
    bad = R.registration_detail_rejects(spark, sf_small, delivered).groupBy("column_name").count()
    counts = {r.column_name: r["count"] for r in bad.collect()}
    assert counts["nation_id"] > 0 and counts["is_online_market_place"] > 0
    measured = dict(seen.get)
    assert measured.pop("rows") == len(got)
    assert {k: v for k, v in measured.items() if v} == counts
    for key, r in got.items():
        c = clean[key]
        assert r.nation_id in (c.nation_id, 0) and r.organisation_name == c.organisation_name
        if c.organisation_id % 10 == 0:
            assert r.nation_id == 0
    one = next(iter(got))
    single = R.organisation_registration_detail(spark, sf_small, one, organisations=delivered, rejects=Observation())
    assert tuple(single.first()) == tuple(got[one])


# layout ----------------------------------------------------------------------
@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    V.use_warehouse(spark, None)


def test_bucketed_layout_joins_without_exchange(spark, sf_small, no_broadcast):
    out = scratch_path(spark, "t-bucketed")
    want = rows(R.paycal_poms(spark, sf_small, 2026))
    want_lines = rows(V.pom_lines(spark, sf_small, V.submissions(spark, sf_small, kind="Registration")))
    made = LY.write_bucketed(spark, sf_small, out, 4, prefix="t_bucketed")
    for paths in (made, LY.open_bucketed(spark, out, 4, prefix="t_reopened")):
        V.use_warehouse(spark, paths)
        lines = V.pom_lines(spark, sf_small, V.submissions(spark, sf_small, kind="Registration"))
        assert "SortMergeJoin" in plan(lines) and "Exchange" not in plan(lines)
        assert rows(lines) == want_lines
        subs = V.submissions(spark, sf_small, years=[2025], kind="Producer")
        by_year = V.pom_lines(spark, sf_small, subs)
        assert "Exchange hashpartitioning" not in plan(by_year) and "PartitionFilters: [isnotnull" in plan(by_year)
        extract = R.paycal_poms(spark, sf_small, 2026)
        assert rows(extract) == want
        every = V.submissions(spark, sf_small)
        assert scanned(every.filter("submission_id = 7")) < every.count() / 2     # one bucket
    V.use_warehouse(spark, None)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def scanned(df):
    """Rows that the file scans of an executed plan gave."""
    df.collect()
    executed = df._jdf.queryExecution().executedPlan()
    todo, total = [executed], 0
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return total


def test_a_lookup_reads_few_row_groups(spark, sf_small):
    """Files are clustered by organisation, so an id is in any row group by its bounds; the bloom filter decides."""
    small = {"parquet.block.size": "4096", "parquet.page.size": "1024", "parquet.block.size.row.check.min": "10",
             "parquet.page.size.row.check.min": "10", "parquet.page.size.row.check.max": "50",
             "parquet.enable.dictionary": "false"}
    paths = LY.write_warehouse(spark, sf_small, scratch_path(spark, "t-bloom"), num_files=1, options=small)
    lines = spark.read.parquet(paths["pom_lines"])
    key = lines.orderBy(F.desc("submission_id")).select("submission_id").first()[0] // 2
    key = lines.filter(F.col("submission_id") >= key).agg(F.min("submission_id")).first()[0]
    total = lines.count()
    spark.conf.set("spark.sql.parquet.filterPushdown", "true")
    with_bloom = scanned(lines.filter(F.col("submission_id") == key))
    off = spark.read.option("parquet.filter.bloom.enabled", "false").parquet(paths["pom_lines"])
    without = scanned(off.filter(F.col("submission_id") == key))
    assert lines.filter(F.col("submission_id") == key).count() >= 1
    assert with_bloom < total / 5 and with_bloom <= without


# reports -----------------------------------------------------------------------
def test_submission_without_lines_is_found(spark, sf_small, tmp_path, monkeypatch):
    asked = V.submissions(spark, sf_small, kind="Producer").orderBy("submission_id").limit(2).select("submission_id")
    first, second = (r[0] for r in asked.collect())
    real = V.read_table

    def without(spark, sf_dir, name, columns=None):
        df = real(spark, sf_dir, name, columns)
        return df.filter(F.col("l_orderkey") != first) if name == "lineitem" else df

    monkeypatch.setattr(V, "read_table", without)
    request = spark.createDataFrame([(first,), (second,), (-5,)], "submission_id long")
    got = {r.submission_id: r for r in R.resubmission_pay_parameters(spark, sf_small, request).collect()}
    assert got[first].member_count == 0 and got[first].outcome != "no_content" and got[first].nation_code
    assert got[second].member_count > 0
    assert got[-5].outcome == "no_content" and got[-5].member_count is None


def test_member_counts_use_hash_aggregates(spark, sf_small):
    subs = V.submissions(spark, sf_small, kind="Producer").withColumn("r", F.lit(True)).withColumn("n", F.lit("x"))
    lines = V.line_members(spark, sf_small)
    text = plan(A.resubmission_parameters(subs, lines, "submission_id", "subsidiary_key", "submitted_at", "r", "n"))
    assert "HashAggregate" in text and "SortAggregate" not in text


def test_one_file_is_looked_up_by_key_in_every_scan(spark, sf_small):
    key = V.submission_events(spark, sf_small, with_reference_only=True).filter(
        "packaging_resubmission_reference_number <> ''").select("submission_id").first()[0]
    one = R.resubmission_synchronised(spark, sf_small, f"{V.FILE_ID_PREFIX.upper()}{key:012d}")
    text = plan(one)
    assert len(re.findall(rf"EqualTo\(user_id,{key}\)", text)) == 2 and f"EqualTo(o_orderkey,{key})" in text
    every = {r.file_id: r.is_synchronised for r in R.resubmission_synchronised(spark, sf_small).collect()}
    for file_id in list(every)[:3]:
        assert api.resubmission_synchronised(spark, sf_small, f" {file_id.upper()} ") == every[file_id]
    assert api.resubmission_synchronised(spark, sf_small, "unknown") is False


def test_request_and_column_dates_are_judged_alike(spark):
    texts = ["2025-01", "20250101", "2025-01-01", "2025-01-01T10:00:00Z", "2025-01-01 10:00:00.5+02:00", "soon", "",
             "2025-13-01", " 2025-01-01 "]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    good, bad = N.split_parsed(frame, "t", "v")
    accepted = {r.t: r.v for r in good.select("t", F.unix_micros("v").alias("v")).collect()}
    for t in texts:
        if t in accepted:
            got = R.parse_request_datetime(t, spark)
            assert got == dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=accepted[t])
        else:
            with pytest.raises(ValueError, match="valid UTC datetime"):
                R.parse_request_datetime(t, spark)
    assert bad.count() + good.count() == len(texts)


def test_padded_request_id_finds_its_period(spark, sf_small):
    sub = R.stored_actual_periods(spark, sf_small).filter("stored_period is not null").orderBy("submission_id").first()
    for asked in (f" {sub.submission_id} ", f"{sub.submission_id}\r\n", f" {sub.file_id.upper()}\n"):
        assert api.actual_submission_period(spark, sf_small, asked, "x") == sub.stored_period


def test_overlay_needs_an_order(spark):
    frame = spark.createDataFrame([("f", "a", "b")], "file_id string, decision string, comments string")
    with pytest.raises(ValueError, match="order"):
        J.overlay_decisions(frame, frame, "file_id")


def test_split_join_keeps_splitting_when_many_keys_are_hot(spark):
    big = spark.range(4000).select((F.col("id") % 40).alias("k"), "id").unionByName(
        spark.range(6000).select(F.lit(7).cast("long").alias("k"), "id"))
    small = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    split = J.split_hot_join(big, small, "k", "left", hot_rows=10, max_hot_keys=3)
    assert rows(split.select("k", "id", "name")) == rows(big.join(small, "k", "left").select("k", "id", "name"))
    assert "Union" in plan(split)


def test_export_does_not_overwrite_by_itself(spark):
    from regsight.sources import export as X
    path = scratch_path(spark, "t-exists")
    X.ndjson_export(spark.range(1), path)
    with pytest.raises(Exception, match="already exists"):
        X.ndjson_export(spark.range(1), path)
