"""Stored layout: partition pruning by year and equality with the views."""

from pyspark.sql import functions as F

from regsight.session import scratch_path
from regsight.sources import layout as L
from regsight.sources import standin as V


def test_warehouse_round_trip_and_pruning(spark, sf_small):
    out = scratch_path(spark, "warehouse")
    paths = L.write_warehouse(spark, sf_small, out, num_files=4)
    stored = L.read_stored(spark, paths["submissions"], years=[2025])
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(submission_year" in plan and "2025" in plan
    view = V.submissions(spark, sf_small, years=[2025])
    cols = sorted(view.columns)
    assert sorted(tuple(r) for r in stored.select(*cols).collect()) == \
        sorted(tuple(r) for r in view.select(*cols).collect())
    lines = L.read_stored(spark, paths["pom_lines"], years=[2025, 2026])
    want = V.pom_lines(spark, sf_small).filter(F.col("submission_year").isin(2025, 2026))
    lcols = sorted(want.columns)
    assert sorted(tuple(r) for r in lines.select(*lcols).collect()) == \
        sorted(tuple(r) for r in want.select(*lcols).collect())


def test_reports_on_stored_layout_equal_derived(spark, sf_small):
    from regsight.plans import reports as R
    paths = L.write_warehouse(spark, sf_small, scratch_path(spark, "warehouse2"), num_files=4)
    for build in (lambda w: R.paycal_poms(spark, sf_small, 2026, warehouse=w),
                  lambda w: R.paycal_organisations(spark, sf_small, 2026, warehouse=w),
                  lambda w: R.approved_submissions_by_year(spark, sf_small, 2025, warehouse=w),
                  lambda w: R.approved_submissions(spark, sf_small, "2024-03-01 00:00:00",
                                                   periods="2024-P1,2024-P4", warehouse=w),
                  lambda w: R.approved_submissions(spark, sf_small, None, periods="2025-H1",
                                                   org_size=None, warehouse=w)):
        derived, stored = build(None), build(paths)
        cols = derived.columns
        assert stored.columns == cols
        assert sorted(tuple(r) for r in stored.collect()) == sorted(tuple(r) for r in derived.collect())
    plan = R.paycal_poms(spark, sf_small, 2026, warehouse=paths)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters" in plan and "Join" not in plan


def test_all_registered_queries_equal_on_stored_layout(spark, sf_small):
    """With a stored layout in use, every registered query still matches its oracle.

    The derived form is checked against the same oracle in test_oracle.py,
    so equality here means the stored layout changes no result.
    """
    import duckdb

    import __spark_entry__ as E
    from regsight.plans import catalog
    from tests.test_oracle import TABLES, _rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    paths = L.write_warehouse(spark, sf_small, scratch_path(spark, "warehouse3"), num_files=4)
    V.use_warehouse(spark, paths)
    try:
        sqls = E.oracle_sql()
        for key in catalog.QUERIES:
            q = E.queries()[key]
            df = q(spark, sf_small)
            cur = con.execute(sqls[key])
            assert df.columns == [d[0] for d in cur.description], key
            assert _rows(tuple(r) for r in df.collect()) == _rows(cur.fetchall()), key
        plan = E.queries()["approved_submissions_by_year"](spark, sf_small)._jdf.queryExecution() \
            .executedPlan().toString()
        assert "PartitionFilters: [isnotnull(submission_year" in plan
    finally:
        V.use_warehouse(spark, None)
