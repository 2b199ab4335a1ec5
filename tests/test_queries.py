"""Every registered query against its SQL, and what the plans must not contain."""

import os
import re

import duckdb
import pytest
from helpers import ordered

import __spark_entry__ as entry
from solvetrail import oracle
from solvetrail.queries import registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
# These run jobs while the query is built, so they have no single plan to look at.
JOBS = ("e8_", "e9_", "e10_", "e11_", "a10_", "a11_", "s6_", "s7_", "s11_", "t1_", "x1_progress")


@pytest.fixture(scope="module")
def database(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cells(rows):
    return ordered(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, folder, database, name):
    frame = registered()[name](spark, folder)
    columns = sorted(frame.columns)
    found = cells(tuple(r[c] for c in columns) for r in frame.collect())
    cursor = database.execute(oracle.statements()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = cells(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert found == expected
    assert found


def test_every_query_has_its_sql():
    assert set(registered()) == set(oracle.statements())
    assert set(registered()) <= set(entry.queries()) and set(oracle.statements()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(n for n in registered() if not n.startswith(JOBS)))
def test_plan(spark, folder, name):
    plan = registered()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_plans_for_tables_too_large_to_broadcast(spark, folder):
    """Without broadcasts the joins are by key, and rows never gather in a window per user."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("e1_solved", "a1_topics", "x7_completion", "a7_complexity_trend", "w5_halves", "j2_calendar"):
            frame = registered()[name](spark, folder)
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
            assert "Broadcast" not in plan
            assert frame.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_columns_reach_the_scan(spark, folder):
    plan = registered()["x2_attempts"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<user_id:bigint,props:string>", plan)


def test_partial_rank_before_the_shuffle(spark, folder):
    """The per-user limit cuts rows on both sides of each shuffle."""
    plan = registered()["e1_solved_short"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"WindowGroupLimit .*20, Partial", plan)) == 2


def test_flagship(spark):
    assert os.path.isdir("/root/testdata/sf0.001")
    frame = entry.entry(spark)
    assert frame.columns == ["user_id", "topic", "total", "solved", "easy", "medium", "hard", "last_solved"]
    assert frame.count() > 0
