"""The registered queries: names, whole tables, SQL where there is some, native plans."""

import duckdb
import pytest
from helpers import ordered

import __spark_entry__ as entry
from solvetrail.llm import registry

NATIVE = ("op2_decontamination", "op3_exact_dedup")


def test_one_query_per_operator():
    numbers = [int(name[2:].split("_")[0]) for name in registry.queries()]
    assert sorted(numbers) == list(range(1, 14))
    assert set(registry.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(registry.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_its_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame = registry.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = ordered(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert ordered(tuple(r[c] for c in columns) for r in frame.collect()) == expected


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, folder, name):
    plan = registry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
