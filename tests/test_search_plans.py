"""A search for all terms stores and shuffles nothing of the texts, and gives what the joined postings give."""

import pytest
from pyspark.sql import functions as F

from weftwork.operators import text as X

DOCS = [(1, "red green blue red"), (2, "green blue"), (3, "red red red"), (4, ""), (5, "blue green, and more red words here")]
TERMS = [("q1", "red"), ("q1", "blue"), ("q1", "red"), ("q2", "green"), ("q3", "red"), ("q3", "nowhere"), ("q4", "words")]


def scores(df):
    return {(r.query, r.doc): round(r.score, 9) for r in df.collect()}


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(DOCS, "id long, text string").repartition(2), spark.createDataFrame(TERMS, "query string, term string")


def test_conjunctive_search_is_that_of_joined_postings(tables):
    docs, terms = tables
    t = X.plain_tokens(F.col("text"))
    got = scores(X.conjunctive_scores(docs, "id", t, terms))
    assert set(got) == {("q1", 1), ("q1", 5), ("q2", 1), ("q2", 2), ("q2", 5), ("q4", 5)}
    assert got == scores(X.bm25_scores(*X.term_hits(docs, "id", t, terms), terms, conjunctive=True)) == scores(X.conjunctive_scores(docs, "id", t, terms, most=1))


def test_conjunctive_search_of_nothing(tables):
    docs, terms = tables
    t = X.plain_tokens(F.col("text"))
    assert scores(X.conjunctive_scores(docs.limit(0), "id", t, terms)) == scores(X.conjunctive_scores(docs, "id", t, terms.limit(0))) == {}


def test_conjunctive_search_of_tables_shuffles_no_texts(spark):
    import os

    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    plan = entry.all_queries()["fts_conjunctive"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan and plan.count("BroadcastHashJoin") == 1
