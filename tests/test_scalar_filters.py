"""P3, P5, P6, P7 and the filters F1-F7."""

import datetime as dt

import pytest

from regsight.functions import scalar as P
from regsight.operators import filters as FL


@pytest.mark.parametrize("code,expected", [("s", "Small"), ("S", "Small"), ("l", "Large"),
                                           ("L", "Large"), (None, "Unknown"), ("", "Unknown"),
                                           (" ", "Unknown"), ("x", "Unknown"),
                                           ("small", "Unknown")])
def test_map_org_size(spark, code, expected):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(P.map_org_size("c")).first()[0] == expected


@pytest.mark.parametrize("as_of,year", [(dt.date(2025, 1, 31), 2023), (dt.date(2025, 2, 1), 2024),
                                        (dt.date(2025, 2, 2), 2024), (dt.date(2026, 3, 1), 2025)])
def test_derive_period_year(spark, as_of, year):
    assert P.derive_period_year(as_of) == year
    df = spark.createDataFrame([(as_of,)], "d date")
    assert df.select(P.period_year_col("d")).first()[0] == year


def test_periods_for_year():
    assert P.periods_for_year(2024) == "2024-P1,2024-P4"
    assert P.periods_for_year(2025) == "2025-H1,2025-H2"


def test_classify_readiness_order(spark):
    rows = [(None, None, None), (True, False, "x"), (True, True, " "), (True, True, None),
            (True, True, "Ref")]
    df = spark.createDataFrame(rows, "found boolean, avail boolean, ref string")
    got = [r[0] for r in df.select(P.classify_readiness("found", "avail", "ref")).collect()]
    assert got == ["no_content", "schema_missing", "reference_missing", "reference_missing", "ready"]


def test_fold_flag(spark):
    df = spark.createDataFrame([(None,), (True,), (False,)], "f boolean")
    assert [r[0] for r in df.select(P.fold_flag("f")).collect()] == [False, True, False]


def test_filter_csv(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    assert FL.filter_csv(df, "v", None).count() == 3
    assert FL.filter_csv(df, "v", "").count() == 3
    assert sorted(r.v for r in FL.filter_csv(df, "v", " a, ,c ").collect()) == ["a", "c"]


def test_filter_optional_eq_and_nation(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    assert FL.filter_optional_eq(df, "n", None).count() == 2
    assert FL.filter_optional_eq(df, "n", 2).count() == 1
    with pytest.raises(ValueError):
        FL.validate_nation(5)


def test_filter_name(spark):
    df = spark.createDataFrame([("Acme Ltd", "R1"), ("Other", "R2")], "name string, ref string")
    assert FL.filter_name(df, "name", "acme").count() == 1
    assert FL.filter_name(df, reference_col="ref", reference="R2").count() == 1


def test_filter_approved_after_is_strict(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1),), (dt.datetime(2025, 1, 2),)],
                               "t timestamp_ntz")
    assert FL.filter_approved_after(df, "t", "2025-01-01 00:00:00").count() == 1


def test_filter_delta_window(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 5),), (dt.datetime(2025, 1, 7),)],
                               "t timestamp_ntz")
    assert FL.filter_delta_window(df, "t", "2025-01-01 00:00:00", "2025-01-07 00:00:00").count() == 2
    assert FL.filter_delta_window(df, "t", "2025-01-10 00:00:00", "2025-01-05 00:00:00").count() == 0


@pytest.mark.parametrize("year", [2025, 2026, 9999])
def test_relative_year_valid(year):
    assert FL.validate_relative_year(year) == year


@pytest.mark.parametrize("year", [None, 2024, 2000, 0, -1, 10000])
def test_relative_year_invalid(year):
    with pytest.raises(ValueError):
        FL.validate_relative_year(year)


def test_filter_relative_year_offsets(spark):
    df = spark.createDataFrame([(2025,), (2026,)], "y int")
    assert FL.filter_relative_year(df, "y", 2026, 1).first().y == 2025
    assert FL.filter_relative_year(df, "y", 2026, 0).first().y == 2026


def test_filter_key_point_and_bulk(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    assert FL.filter_key(df, "id", 2).first().v == "b"
    ids = spark.createDataFrame([(1,), (3,), (3,)], "x int")
    assert sorted(r.id for r in FL.filter_key(df, "id", ids).collect()) == [1, 3]
    assert FL.filter_key(df.select("v", "id"), "id", ids).columns == ["v", "id"]
    with pytest.raises(ValueError):
        FL.filter_key(df, "v", " ")
