"""Every query with SQL: same rows from Spark and from DuckDB on the smallest tables,
by a plan without Python and without a cross join.
"""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from truthmill.plans.catalog import QUERIES
from truthmill.plans.oracles import ORACLES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _sortable(row):
    return tuple((v is None, str(type(v)) if isinstance(v, str) else "", v if v is not None else 0) for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    ours = sorted(([row[c] for c in columns] for row in df.collect()), key=_sortable)
    theirs = sorted(([row[names.index(c)] for c in columns] for row in result.fetchall()), key=_sortable)
    assert len(ours) == len(theirs)
    for left, right in zip(ours, theirs):
        assert all(_same(a, b) for a, b in zip(left, right)), (left, right)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) ))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_hashed_counts_lose_no_bigram(spark):
    hashed = entry.queries()["hashing_tf"](spark, FOLDER).agg({"total": "sum"}).first()[0]
    assert hashed == entry.queries()["bigrams"](spark, FOLDER).agg({"n": "sum"}).first()[0]
