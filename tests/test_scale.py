"""What keeps the memory of one task within bounds: sides of joins, and bytes per task."""

import pytest
from helpers import problems, values
from pyspark.sql import functions as F

from solvetrail.operators import changes, topics
from solvetrail.plans.jobs import COMPARED, KEPT, KEY, TITLE
from solvetrail.session import FACTOR, MOST, tune
from solvetrail.sources import mapping as topic_mapping

MAPPING = (("small", "Size"), ("large", "Size"), ("red", "Colour"))


@pytest.fixture
def restored(spark):
    """A session whose settings go back after the test."""
    names = (*MOST, FACTOR, "spark.sql.adaptive.enabled")
    before = {name: spark.conf.get(name) for name in names}
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_mapped_totals_keep_the_rows_side_of_the_join(spark):
    rows = problems(
        spark,
        [(1, "Easy", ["small", "red"], 1), (1, "Hard", ["small", "large"], 3), (2, "Easy", [], 1), (2, "Easy", None, 1), (2, "Medium", ["other"], None)],
    )
    found = topics.topic_totals(rows, MAPPING)
    # An inner join may broadcast the rows, and then one task has all of them.
    assert "Join LeftOuter, (topics#" in optimized(found)
    assert values(found, "user_id", "topic", "total", "easy", "medium", "hard") == [
        (1, "Colour", 1, 1, 0, 0), (1, "Size", 2, 1, 0, 1), (2, "other", 1, 0, 1, 0),
    ]


def test_mapped_totals_are_those_of_carried_categories(spark):
    rows = problems(spark, [(u, "Easy", [t], d) for u in (1, 2) for d, t in enumerate(("small", "red", "Redder", "", "x"), 1)])
    carried = topics.topic_totals(topic_mapping.with_categories(rows, MAPPING), MAPPING)
    assert values(topics.topic_totals(rows, MAPPING)) == values(carried)


def test_millions_of_stored_rows_in_a_small_file_are_not_broadcast(restored, tmp_path):
    restored.conf.set("spark.sql.adaptive.enabled", "false")
    number = F.col("id")
    rows = restored.range(0, 1_500_000, 1, 4).select(
        (number % 20_000).alias("user_id"),
        F.concat(F.lit("Item "), number.cast("string")).alias("name"),
        F.lit("Easy").alias("difficulty"),
        F.lit("small, red").alias("topics_text"),
        F.lit("2024-01-01").cast("date").alias("date_solved"),
        F.lit(1).cast("bigint").alias("attempts"),
        F.lit("Solved").alias("status"),
        number.cast("string").alias("problem_id"),
        F.lit("2024-01").alias("month"),
    )
    rows.write.parquet(f"{tmp_path}/rows")
    stored = restored.read.parquet(f"{tmp_path}/rows")
    plan = lambda: changes.upserts(stored, stored, KEY, TITLE, COMPARED, KEPT)._jdf.queryExecution().executedPlan().toString()
    restored.conf.set("spark.sql.adaptive.enabled", "false")
    assert "BroadcastHashJoin" not in plan()


def test_stored_rows_of_fetched_titles_are_written_once(spark, tmp_path):
    """Both joins of an upsert read what is left of the stored rows, and the outcome is the same without writing it."""
    columns = "user_id bigint, name string, difficulty string, topics_text string, date_solved string, attempts bigint, status string, problem_id string, month string"
    frame = lambda *rows: spark.createDataFrame([(u, n, d, "t", on, 1, "Solved", p, "m") for u, n, d, p, on in rows], columns)
    stored = frame((1, "a", "Easy", "1", "x"), (1, "b", "Easy", "2", "x"), (1, "b", "Easy", "2", "x"), (2, "c", "Hard", "3", "x"), (None, "a", "Easy", "1", "x"))
    fetched = frame((1, "a", "Hard", "1", "y"), (1, "b", "Easy", "2", "y"), (1, "b", "Hard", "9", "y"), (1, "d", "Easy", "4", "y"), (None, "a", "Easy", "1", "y"))
    written = []

    def stage(rows):
        written.append(values(rows, "user_id", "name"))
        rows.write.parquet(f"{tmp_path}/{len(written)}")
        return spark.read.schema(rows.schema).parquet(f"{tmp_path}/{len(written)}")

    found = values(changes.upserts(fetched, stored, KEY, TITLE, COMPARED, KEPT, stage), *KEY, "difficulty", "date_solved", "change")
    assert found == [(1, "a", "1", "Hard", "x", "updated"), (1, "d", "4", "Easy", "y", "new"), (None, "a", "1", "Easy", "y", "new")]
    assert written == [[(1, "a"), (1, "b"), (1, "b")]]
    assert found == values(changes.upserts(fetched, stored, KEY, TITLE, COMPARED, KEPT), *KEY, "difficulty", "date_solved", "change")


@pytest.mark.parametrize("size, kept", [("128MB", False), ("134217728b", False), ("1g", False), ("16m", True), ("1m", True), ("64k", True), ("900", True)])
def test_a_task_reads_bounded_bytes(restored, size, kept):
    for name in MOST:
        restored.conf.set(name, size)
    before = [restored.conf.get(name) for name in MOST]
    tune(restored)
    after = [restored.conf.get(name) for name in MOST]
    assert after == (before if kept else [f"{16 << 20}b"] * 2)


def test_a_larger_factor_is_kept(restored):
    for given, expected in (("1.0", 10.0), ("25.0", 25.0)):
        restored.conf.set(FACTOR, given)
        assert float(tune(restored).conf.get(FACTOR)) == expected
