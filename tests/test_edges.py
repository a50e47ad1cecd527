"""Nulls, sub-seconds, malformed requests and new files: one answer on every path."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from regsight.functions import normalise as N
from regsight.operators import aggregate as A
from regsight.operators import filters as FL
from regsight.operators import joins as J
from regsight.operators import paging as W
from regsight.operators import project as PR
from regsight.sources import tables as TB

GUID = "0a1b2c3d-0000-4000-8000-00000000000a"


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("page", [1, 2, 3])
def test_page_with_null_sort_keys_is_the_same_shallow_and_deep(spark, page):
    df = spark.createDataFrame([(1, None, "a"), (2, 5, None), (3, None, "c"), (4, 1, "d"), (5, None, None)],
                               "id int, k int, v string")
    order = [F.col("k").asc_nulls_last(), F.col("id")]
    shallow = W.page_rows(df, order, page, 2)
    deep = W.page_rows(df, order, page, 2, deep_threshold=0, key_cols=["k", "id"])
    assert [tuple(r) for r in shallow.collect()] == [tuple(r) for r in deep.collect()]


def test_history_with_null_keys_is_the_same_plain_and_split(spark):
    rows = [(g, None if i % 5 == 0 else i, i, "Rejected" if i % 2 else "Accepted", f"c{i}")
            for g in (None, 1, 2) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "g int, at int, id int, status string, comments string")
    args = (["g"], ["at", "id"], "status", "comments")
    plain = W.resubmission_history(df, *args)
    split = W.resubmission_history(df, *args, num_pieces=3, hot_rows=4)
    assert _rows(plain) == _rows(split)
    assert plain.count() == len(rows)


def test_clamp_page():
    assert [W.clamp_page(p, 10, 25) for p in (1, 3, 4, 99)] == [1, 3, 3, 3]
    assert [W.clamp_page(p, 10, 0) for p in (1, 7)] == [1, 1]
    assert W.clamp_page(-2, 10, 25) == 1


def test_files_that_land_or_change_are_seen(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    spark.range(3).write.parquet(path)
    assert TB.read_path(spark, path).count() == 3
    spark.range(2).write.mode("append").parquet(path)
    assert TB.read_path(spark, path).count() == 5
    spark.range(1).write.mode("overwrite").parquet(path)
    assert TB.read_path(spark, path).count() == 1
    assert os.path.exists(path)


def test_null_date_is_a_reject(spark):
    df = spark.createDataFrame([("2025-01-05T00:00:00Z",), ("nope",), (None,)], "t string")
    good, bad = N.split_parsed(df, "t", "at")
    assert good.count() == 1 and bad.count() == 2


def test_guid_loses_line_breaks(spark):
    df = spark.createDataFrame([(GUID.upper() + "\r\n",), ("\t" + GUID + " ",), (GUID,)], "g string")
    assert {r[0] for r in df.select(N.norm_guid("g")).collect()} == {GUID}
    assert spark.createDataFrame([(GUID + "\nx",)], "g string").select(N.try_norm_guid("g")).first()[0] is None


def test_instants_keep_fractions_and_zones(spark):
    df = spark.sql("select timestamp_ntz'2025-01-01 12:00:00.5' as at")
    noon = dt.datetime(2025, 1, 1, 12)
    assert FL.filter_delta_window(df, "at", noon, noon.replace(microsecond=900_000)).count() == 1
    assert FL.filter_approved_after(df, "at", noon.replace(microsecond=700_000)).count() == 0
    east = dt.datetime(2025, 1, 1, 17, tzinfo=dt.timezone(dt.timedelta(hours=5)))
    assert FL.filter_approved_after(df, "at", east).count() == 1


def test_malformed_decisions_fail(spark):
    df = spark.createDataFrame([('[{"FileId": "x"}, {"FileId"',)], "j string")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        PR.decode_decisions(df, "j").collect()


def test_lookup_keeps_the_rows(spark):
    df = spark.createDataFrame([(1, "r"), (2, "r")], "id int, asked string")
    stored = spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], "id int, period string")
    out = J.lookup_period(df, stored, "id", "period", "asked")
    assert {r.id: r.actual_submission_period for r in out.collect()} == {1: "a", 2: "r"} and out.count() == 2


def test_weights_above_the_int_range(spark):
    df = spark.createDataFrame([("p", 2.0e9)] * 2, "k string, w double")
    assert A.approved_weights(df, "w", ("k",)).first().packaging_material_weight == 4_000_000_000
