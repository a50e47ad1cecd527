"""Pages from a stored order, change sets of two vintages, name search by trigrams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from regsight.operators import changes as CH
from regsight.operators import filters as FL
from regsight.operators import name_index as NI
from regsight.operators import page_directory as PD
from regsight.plans import reports as R
from regsight.session import scratch_path
from regsight.sources import standin as V

def order():
    return [F.col("a").asc_nulls_last(), F.col("b").desc(), F.col("id").asc()]


def listed(spark, n=500):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, a int, b string")


# L1 / L2 ---------------------------------------------------------------------
def test_pages_of_a_directory_equal_the_sort(spark):
    df, path = listed(spark), scratch_path(spark, "t-directory")
    made = PD.write_directory(df.repartition(6), path, order(), as_of="t1", range_rows=60)
    assert made == PD.open_directory(spark, path, as_of="t1") and made.total == 500 and made.ranges == 9
    want = [tuple(r) for r in df.orderBy(*order()).collect()]
    for size in (7, 60, 170):
        last = math.ceil(500 / size)
        for page in (1, 2, last - 1, last, 10 ** 9):
            got = PD.directory_page(spark, made, order(), page, size)
            at = min(page, last)
            assert got.current_page == at and got.total_items() == 500
            assert [tuple(r)[:3] for r in got.items.collect()] == want[(at - 1) * size:at * size]
    plain = PD.directory_page(spark, made, order(), 10 ** 9, 7, clamped=False)
    assert plain.items.collect() == [] and plain.current_page == 10 ** 9
    with pytest.raises(ValueError, match="as of t1"):
        PD.open_directory(spark, path, as_of="t2")
    with pytest.raises(ValueError):
        PD.directory_page(spark, made, order(), 1, 0)


def test_a_deep_page_reads_its_ranges_only(spark):
    path = scratch_path(spark, "t-deep")
    made = PD.write_directory(listed(spark), path, order(), range_rows=50)
    rows = PD.directory_rows(spark, made, order(), 320, 10)
    assert len({f for f in rows.inputFiles()}) <= 10
    files = rows.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 2
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in text and "rangepartitioning" not in text


def test_directory_of_no_rows(spark):
    path = scratch_path(spark, "t-none")
    made = PD.write_directory(listed(spark).limit(0), path, order())
    page = PD.directory_page(spark, PD.open_directory(spark, path), order(), 5, 10)
    assert made.total == 0 and page.items.collect() == [] and page.current_page == 1
    assert page.items.columns == ["id", "a", "b", "total_items"]


# F5 ----------------------------------------------------------------------------
def test_change_set_of_keys_nulls_and_repeated_rows(spark):
    schema = "k int, j string, v string, w string"
    old = spark.createDataFrame([(1, "a", "x", None), (2, "a", "x", "y"), (3, "a", "x", "y"), (4, "a", "x", "y"),
                                 (4, "a", "z", "y"), (None, "a", "x", "y"), (5, None, "x", "y"), (6, "a", None, "b"),
                                 (7, "a", "s", "s"), (7, "a", "s", "s")], schema)
    new = spark.createDataFrame([(1, "a", "x", None), (2, "a", "x", "q"), (4, "a", "z", "y"), (4, "a", "x", "y"),
                                 (None, "a", "x", "Y"), (5, None, "x", ""), (8, "a", "x", "y"), (6, "a", "b", None),
                                 (7, "a", "s", "s")], schema)
    got = {(r.k, r.j): r.change for r in CH.changed_keys(old, new, ["k", "j"]).collect()}
    assert got == {(2, "a"): "updated", (3, "a"): "removed", (None, "a"): "updated", (5, None): "updated",
                   (6, "a"): "updated", (7, "a"): "updated", (8, "a"): "inserted"}
    rows = sorted((tuple(r) for r in CH.change_set(old, new, ["k", "j"]).collect()), key=repr)
    assert rows == sorted([("updated", 2, "a", "x", "q"), ("removed", 3, "a", "x", "y"),
                           ("updated", None, "a", "x", "Y"), ("updated", 5, None, "x", ""),
                           ("updated", 6, "a", "b", None), ("updated", 7, "a", "s", "s"),
                           ("inserted", 8, "a", "x", "y")], key=repr)
    assert CH.changed_keys(old, new, ["k", "j"], ["v"]).filter("k = 2").isEmpty()
    assert CH.changed_keys(old, old.repartition(3), ["k", "j"]).isEmpty()
    wider = new.withColumn("extra", F.lit(1))
    assert CH.changed_keys(new, wider, ["k", "j"]).count() == new.select("k", "j").distinct().count()
    assert CH.change_set(new.drop("w"), new, ["k", "j"], ["v"]).isEmpty()


def test_changed_producers_follow_the_vintages(spark, sf_small):
    old, new = (V.organisation_vintage(spark, sf_small, v) for v in (1, 2))
    out = R.changed_producers(spark, sf_small, old, new, "2025-06-30 00:00:00")
    by = {r.status: r["count"] for r in out.groupBy("status").count().collect()}
    assert set(by) == {"inserted", "updated", "removed"}
    assert R.changed_producers(spark, sf_small, new, new, "2025-06-30 00:00:00").isEmpty()
    # a column that the extract does not show is no change
    hidden = new.withColumn("nation_id", F.lit(9))
    assert R.changed_producers(spark, sf_small, new, hidden, "2025-06-30 00:00:00").isEmpty()


def test_only_narrow_rows_are_shuffled(spark, sf_small):
    old, new = (V.organisation_vintage(spark, sf_small, v) for v in (1, 2))
    plan = CH.changed_keys(old, new, ["organisation_id"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "NestedLoop" not in plan


# F3 ------------------------------------------------------------------------------
NAMES = ["Acme Packaging Ltd", "ACME", "Packages & Co", None, "", "ab", "Zürich Ölmühle", "aaa", "aaaa", "x" * 300,
         "100%_pack\\age", "Pack Age Ltd", "LTD"] + [f"Company {i:04d} Ltd" for i in range(300)]


def test_name_search_equals_contains(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)] + [(0, "Second name of Acme")],
                               "id long, name string")
    path = NI.write_name_index(df, scratch_path(spark, "t-names"), "id", "name", num_files=4)
    for pattern in ["acme", "ACME p", "pack", "ltd", "Company 01", "any 0299 L", "ölm", "a", "ab", "aaa", "aaaa", "xxx",
                    "%_p", "\\a", "nowhere", "0 l", "é", "second", "x" * 300, "x" * 301]:
        got = sorted(tuple(r) for r in NI.search_names(spark, path, pattern).collect())
        want = sorted(tuple(r) for r in FL.filter_name(df, "name", pattern).collect())
        assert got == want, pattern


def test_a_search_reads_the_rarest_postings(spark):
    df = spark.createDataFrame([(i, f"Common Ltd {i:05d}") for i in range(4000)], "id long, name string")
    path = NI.write_name_index(df, scratch_path(spark, "t-rare"), "id", "name", num_files=3)
    out = NI.search_names(spark, path, "common ltd 01234")
    assert [tuple(r) for r in out.collect()] == [(1234, "Common Ltd 01234")]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in text or "Or(" in text or "gram IN" in text
