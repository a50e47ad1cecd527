"""Every registered query against its DuckDB oracle on the smallest tables."""

import datetime as dt
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as E
from regsight.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
SPARK_TO_DUCK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE"}
KEYS = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_small, t + '.parquet')}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return repr(v)


def _rows(rows):
    return sorted("|".join(_norm(v) for v in r) for r in rows)


def test_every_query_has_oracle():
    assert set(KEYS) <= set(E.oracle_sql()) and set(KEYS) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, sf_small, key):
    df = E.queries()[key](spark, sf_small)
    cur = con.execute(E.oracle_sql()[key])
    assert df.columns == [d[0] for d in cur.description]
    assert len(set(df.columns)) == len(df.columns), "column names must be unique"
    spark_types = [SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields]
    assert spark_types == [str(d[1]) for d in cur.description]
    assert _rows(tuple(r) for r in df.collect()) == _rows(cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["submission_period", "packaging_material"]
    assert df.count() >= 0
