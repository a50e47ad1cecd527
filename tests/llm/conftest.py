import os

import duckdb
import pytest

from regsight.llm.ship import ship_package

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents():
    con = duckdb.connect()
    return con.execute(f"SELECT doc_id, text, lang, source FROM '{os.path.join(SF, 'documents.parquet')}'").fetchall()


def docs_frame(spark, rows):
    """Documents from (doc_id, text, lang, source) rows, with columns that clash with results."""
    full = [(i, t, lang, s, len(t) if t is not None else None, "x", 1.5) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS + ", kept string, score double")


EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "...!!", "en", None), (4, "word", None, "a"),
        (4, "word", None, "a"), (None, "Word", "en", "b"), (5, "é " * 30_000, "fr", "a"),
        (6, "token = abc", "en", "b"), (7, "one two three four five six seven", "en", "a"),
        (8, "One two three four five six seven", "en", "a"), (9, "x" * 200_000, "de", "b")]
