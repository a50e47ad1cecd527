"""The reports as SQL table functions: arguments, errors, and the plans behind them."""

import re

import pytest

from regsight.plans import reports as R
from regsight.plans import sql_functions as SQ
from regsight.sources import standin as V


@pytest.fixture(scope="module")
def functions(spark, sf_small):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield SQ.create_functions(spark, sf_small)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_submission(spark, sf_small, kind):
    ids = V.submission_events(spark, sf_small).select("submission_id")
    return V.submissions(spark, sf_small, kind=kind).join(ids, "submission_id", "left_semi").orderBy(
        "submission_id").first()


def test_every_report_has_a_function(functions):
    from regsight.plans import catalog
    reports = list(catalog.QUERIES)[:16]
    assert set(reports) <= set(functions)


def test_named_arguments_in_any_order_and_defaults(spark, functions):
    named = spark.sql("SELECT * FROM approved_submissions_by_year(types => 'HH', period_year => 2025)")
    placed = spark.sql("SELECT * FROM approved_submissions_by_year(2025, 'HH')")
    assert rows(named) == rows(placed) != rows(spark.sql("SELECT * FROM approved_submissions_by_year(2025)"))
    blank = spark.sql("SELECT * FROM approved_submissions_by_year(period_year => 2025, types => ' , ')")
    assert rows(blank) == rows(spark.sql("SELECT * FROM approved_submissions_by_year(2025, types => NULL)"))


def test_typed_markers(spark, sf_small):
    out = SQ.call(spark, sf_small, "SELECT * FROM paycal_poms(relative_year => :year)", {"year": 2026})
    assert rows(out) == rows(R.paycal_poms(spark, sf_small, 2026))


@pytest.mark.parametrize("query", [
    "SELECT * FROM paycal_poms(2024)", "SELECT * FROM paycal_organisations(relative_year => 10000)",
    "SELECT * FROM registration_fee_details('  ')", "SELECT * FROM resubmission_synchronised(file_id => '')",
    "SELECT * FROM organisation_registration_summaries(nation_id => 5)",
    "SELECT * FROM updated_producers(from_date => TIMESTAMP_NTZ'2025-01-01')",
    "SELECT * FROM paycal_poms(year => 2026)",
    "SELECT * FROM pom_summaries(decisions_delta => '[{')"])
def test_wrong_arguments_fail(spark, functions, query):
    with pytest.raises(Exception):
        spark.sql(query).collect()


def test_single_ids_equal_the_dataframe_reports(spark, sf_small, functions):
    sub = some_submission(spark, sf_small, "Registration")
    got = spark.sql(f"SELECT * FROM organisation_registration_detail({sub.submission_id})")
    assert rows(got) == rows(R.organisation_registration_detail(spark, sf_small, sub.submission_id)) != []
    got = spark.sql(f"SELECT * FROM registration_fee_details(file_id => ' {sub.file_id.upper()}')")
    assert rows(got) == rows(R.registration_fee_details(spark, sf_small, sub.file_id)) != []
    assert spark.sql("SELECT * FROM registration_fee_details('no file of ours')").count() == 0
    flags = spark.sql(f"SELECT * FROM sync_available(file_id => '{sub.file_id}'), "
                      f"sync_available(submission_id => -1)").first()
    assert tuple(flags) == (True, False)
    pom = some_submission(spark, sf_small, "Producer")
    asked = spark.createDataFrame([(pom.submission_id,)], "submission_id long")
    got = spark.sql(f"SELECT * FROM resubmission_pay_parameters(submission_id => {pom.submission_id})")
    assert rows(got) == rows(R.resubmission_pay_parameters(spark, sf_small, asked)) != []
    assert rows(spark.sql(f"SELECT * FROM resubmission_synchronised('{pom.file_id}')")) == rows(
        R.resubmission_synchronised(spark, sf_small, pom.file_id).select("is_synchronised"))


def test_history_of_one_submission_equals_the_window(spark, functions):
    """Also for later submissions of a group, whose predecessor was rejected or not."""
    every = spark.sql("SELECT * FROM organisation_registration_details() WHERE is_resubmission "
                      "ORDER BY submission_id LIMIT 3").collect()
    assert every
    for r in every:
        assert tuple(spark.sql(f"SELECT * FROM organisation_registration_detail({r.submission_id})").first()) \
            == tuple(r)


def test_lists_are_paged_by_the_caller(spark, sf_small, functions):
    page = R.registration_summaries(spark, sf_small, decisions="[]", page_number=2, page_size=7).items
    got = spark.sql("SELECT * FROM registration_summaries() ORDER BY registration_date DESC, submission_id "
                    "LIMIT 7 OFFSET 7")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in page.drop("total_items").collect()]


def test_functions_join_and_nest(spark, functions):
    out = spark.sql("""SELECT p.organisation_id, count(*) AS n
        FROM updated_producers(TIMESTAMP_NTZ'2025-01-01', TIMESTAMP_NTZ'2025-12-31') p
        JOIN paycal_organisations(2025) o ON p.organisation_id = CAST(o.organisation_id AS STRING)
        GROUP BY p.organisation_id""")
    assert out.count() > 0 and out.filter("n <> 1").isEmpty()


def test_arguments_reach_the_scans(spark, functions):
    key = 7
    detail = plan(spark.sql(f"SELECT * FROM registration_fee_details('{V.FILE_ID_PREFIX}{key:012d}')"))
    for column in ("o_orderkey", "l_orderkey"):
        assert re.search(rf"PushedFilters: \[[^\]]*EqualTo\({column},{key}\)", detail), column
    year = plan(spark.sql("SELECT * FROM paycal_poms(2026)"))
    assert "GreaterThanOrEqual(o_orderdate" in year and "LessThan(o_orderdate" in year
    delta = plan(spark.sql("SELECT * FROM updated_producers(TIMESTAMP_NTZ'2025-01-01', TIMESTAMP_NTZ'2025-02-01')"))
    assert "LessThanOrEqual(o_orderdate" in delta
    parameters = plan(spark.sql("SELECT * FROM resubmission_pay_parameters(7)"))
    for column in ("o_orderkey", "l_orderkey", "user_id"):
        assert f"EqualTo({column},7)" in parameters, column
    assert "Window" not in parameters and "CartesianProduct" not in parameters


def test_lateral_call_over_files_is_a_join(spark, functions):
    out = spark.sql("""SELECT f.* FROM (SELECT file_id FROM rs_submissions WHERE submission_type = 'Registration') s,
        LATERAL registration_fee_details(file_id => s.file_id) f""")
    text = plan(out)
    assert "NestedLoop" not in text and "CartesianProduct" not in text
