"""Converter cases (N1-N9) and schema handling."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from regsight.functions import normalise as N

GUID = "3fa85f64-5717-4562-b3fc-2c963f66afa6"


def _one(spark, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}")


@pytest.mark.parametrize("value,expected", [(None, None), ("", None), (GUID, GUID),
                                            (GUID.upper(), GUID)])
def test_norm_guid_cases(spark, value, expected):
    assert _one(spark, value).select(N.norm_guid("v")).first()[0] == expected


def test_norm_guid_invalid_raises(spark):
    with pytest.raises(Exception, match="invalid guid"):
        _one(spark, "invalid-guid-string").select(N.norm_guid("v")).collect()


def test_try_norm_guid_invalid_is_null(spark):
    assert _one(spark, "invalid-guid-string").select(N.try_norm_guid("v")).first()[0] is None


@pytest.mark.parametrize("value,expected", [(None, None), ("", None), ("101", 101)])
def test_norm_int_cases(spark, value, expected):
    assert _one(spark, value).select(N.norm_int("v")).first()[0] == expected


@pytest.mark.parametrize("bad", ["abc", " "])
def test_norm_int_invalid_raises(spark, bad):
    with pytest.raises(Exception):
        _one(spark, bad).select(N.norm_int("v")).collect()


@pytest.mark.parametrize("value,expected", [(0, False), (1, True), (-1, False), (None, None)])
def test_int_to_bool(spark, value, expected):
    assert _one(spark, value, "int").select(N.int_to_bool("v")).first()[0] == expected


@pytest.mark.parametrize("value,expected", [(True, 1), (False, 0), (None, 0)])
def test_bool_to_int(spark, value, expected):
    assert _one(spark, value, "boolean").select(N.bool_to_int("v")).first()[0] == expected


def test_norm_timestamp_cases(spark):
    rows = spark.createDataFrame([(None,), ("",), ("2024-01-02T03:04:05.1234567Z",)], "v string")
    got = [r[0] for r in rows.select(N.norm_timestamp("v").cast("timestamp_ntz")).collect()]
    assert got == [None, None, dt.datetime(2024, 1, 2, 3, 4, 5, 123456)]


def test_norm_timestamp_invalid_raises(spark):
    with pytest.raises(Exception, match="invalid timestamp"):
        _one(spark, "2024-01-02 03:04:05").select(N.norm_timestamp("v")).collect()


def test_format_timestamp_seven_digits(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 123456),)], "v timestamp_ntz")
    assert df.select(N.format_timestamp("v")).first()[0] == "2024-01-02T03:04:05.1234560Z"


@pytest.mark.parametrize("value,expected", [(12345, "12345"), (0, "0"), (-9999, "-9999"),
                                            (None, None)])
def test_int_to_reference(spark, value, expected):
    assert _one(spark, value, "int").select(N.int_to_reference("v")).first()[0] == expected


@pytest.mark.parametrize("value,expected", [("54321", 54321), ("", None), ("   ", None),
                                            (None, None)])
def test_reference_to_int(spark, value, expected):
    assert _one(spark, value).select(N.reference_to_int("v")).first()[0] == expected


def test_reference_to_int_invalid_raises(spark):
    with pytest.raises(Exception):
        _one(spark, "12a").select(N.reference_to_int("v")).collect()


def test_sanitise_and_decode(spark):
    df = spark.createDataFrame([("ab\r\ncd\n", "July+to%20December+2025")], "a string, b string")
    row = df.select(N.sanitise_id("a"), N.decode_period("b")).first()
    assert tuple(row) == ("abcd", "July to December 2025")


def test_split_parsed_rejects_with_message(spark):
    df = spark.createDataFrame([(1, "2025-03-01"), (2, "invalid date string")], "id int, t string")
    good, bad = N.split_parsed(df, "t", "ts")
    assert [r.id for r in good.collect()] == [1]
    rej = bad.collect()
    assert [r.id for r in rej] == [2] and "valid UTC datetime" in rej[0].error


def test_reject_counts(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("",)], "v string")
    assert df.transform(lambda d: N.reject_counts(d, {"v": N.try_norm_int("v")})).first()[0] == 1


def test_normalise_table_one_projection(spark):
    df = spark.createDataFrame([("", "1", "keep")], "a string, b string, c string")
    out = N.normalise_table(df, {"a": N.norm_int, "b": N.norm_int})
    assert tuple(out.first()) == (None, 1, "keep")


def test_align_schema_case_insensitive_defaults(spark):
    df = spark.createDataFrame([(1, "x", None, "oops")], "Id bigint, NAME string, Flag boolean, n string")
    target = T.StructType([
        T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), True),
        T.StructField("flag", T.BooleanType(), False), T.StructField("n", T.IntegerType(), False),
        T.StructField("missing", T.StringType(), True), T.StructField("count", T.IntegerType(), False)])
    row = N.align_schema(df, target).first()
    assert row.asDict() == {"id": 1, "name": "x", "flag": False, "n": 0, "missing": None, "count": 0}


def test_evolve_schema_adds_only_absent(spark):
    df = spark.createDataFrame([(1, "keep")], "id int, Comments string")
    out = N.evolve_schema(df, {"comments": T.StringType(), "decision": T.StringType(),
                               "is_resubmission_required": T.BooleanType()})
    assert out.columns == ["id", "Comments", "decision", "is_resubmission_required"]
    assert out.first().Comments == "keep"
    assert N.evolve_schema(out, {"decision": T.StringType()}) is out


def test_union_vintages(spark):
    old = spark.createDataFrame([(1,)], "id int")
    new = spark.createDataFrame([(2, "x")], "id int, decision string")
    got = sorted((r.id, r.decision) for r in N.union_vintages(new, old).collect())
    assert got == [(1, None), (2, "x")]


@pytest.mark.parametrize("rule,bad", [(N.norm_int, "abc"), (N.norm_int, " "),
                                      (N.reference_to_int, "12a")])
def test_strict_rules_raise_with_ansi_off(spark, rule, bad):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="invalid"):
            _one(spark, bad).select(rule("v")).collect()
        assert _one(spark, "42").select(rule("v")).first()[0] == 42
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
