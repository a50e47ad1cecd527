"""Property-based checks of the pure rules and of converter round trips."""

import datetime as dt
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from regsight.functions import normalise as N
from regsight.functions import scalar as P
from regsight.operators import filters as FL
from regsight.operators import paging as W
from regsight.sources import export as X


@given(page=st.integers(0, 10 ** 6), size=st.integers(1, 500), total=st.integers(0, 10 ** 7))
def test_clamp_page_invariants(page, size, total):
    cur = W.clamp_page(page, size, total)
    last = max(1, math.ceil(total / size))
    assert 1 <= cur <= last
    if 1 <= page <= last:
        assert cur == page


@given(day=st.dates(dt.date(2000, 1, 1), dt.date(2100, 12, 31)))
def test_period_year_is_one_or_two_years_back(day):
    year = P.derive_period_year(day)
    assert year == day.year - (1 if (day.month, day.day) >= (2, 1) else 2)
    periods = P.periods_for_year(year).split(",")
    assert len(periods) == 2 and all(p.startswith(f"{year}-") for p in periods)


@given(items=st.lists(st.text(alphabet="ABC-12", min_size=0, max_size=5), max_size=6))
def test_csv_items_drop_blanks_and_trim(items):
    got = FL.csv_items(",".join(f" {x} " for x in items))
    want = [x for x in items if x.strip()]
    assert got == (want or None)


@given(words=st.lists(st.text(alphabet="abcxyz", min_size=1, max_size=6), min_size=1, max_size=4))
def test_camel_case_of_snake(words):
    name = "_".join(words)
    camel = X.camel_case(name)
    assert camel[0].islower() and "_" not in camel
    assert camel.lower() == name.replace("_", "")


@settings(max_examples=15, deadline=None)
@given(moment=st.datetimes(dt.datetime(1990, 1, 1), dt.datetime(2090, 1, 1)))
def test_request_datetime_round_trip(spark, moment):
    from regsight.plans.reports import parse_request_datetime
    assert parse_request_datetime(moment.isoformat() + "Z", spark) == moment


@settings(max_examples=5, deadline=None)
@given(values=st.lists(st.integers(-2 ** 31, 2 ** 31 - 1), min_size=1, max_size=40))
def test_reference_and_int_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    out = df.select(N.reference_to_int(N.int_to_reference("v")).alias("r"),
                    N.norm_int(N.int_to_reference("v")).alias("i")).collect()
    assert [r.r for r in out] == values and [r.i for r in out] == values


@settings(max_examples=5, deadline=None)
@given(stamps=st.lists(st.datetimes(dt.datetime(1970, 1, 2), dt.datetime(2200, 1, 1)),
                       min_size=1, max_size=30))
def test_timestamp_text_round_trip(spark, stamps):
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp_ntz")
    back = df.select(N.norm_timestamp(N.format_timestamp("t")).cast("timestamp_ntz").alias("b"))
    assert [r.b for r in back.collect()] == stamps


@settings(max_examples=5, deadline=None)
@given(codes=st.lists(st.one_of(st.none(), st.text(alphabet="sSlLx ", max_size=3)), min_size=1,
                      max_size=30))
def test_size_mapping_matches_rule(spark, codes):
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r[0] for r in df.select(P.map_org_size("c")).collect()]
    want = [{"s": "Small", "l": "Large"}.get((c or "").lower(), "Unknown") for c in codes]
    assert got == want
