import datetime as dt
import random

from helpers import ordered, problems, values
from pyspark.sql import functions as F

from solvetrail.operators import select

SUBS = "user_id bigint, seq bigint, title_slug string, status string"


def submissions(spark, rows):
    return spark.createDataFrame(rows, SUBS)


def test_accepted_and_slug(spark):
    rows = [(1, 1, "a", "Accepted"), (1, 2, "b", "accepted"), (1, 3, "", "Accepted"), (1, 4, None, "Accepted")]
    frame = select.with_slug(select.accepted(submissions(spark, rows)))
    assert values(frame, "seq") == [(1,)]


def test_with_title(spark):
    frame = spark.createDataFrame([(None,), ("",), ("  ",), ("\tx",)], "title string")
    assert values(select.with_title(frame)) == [("\tx",)]


def test_first_n_with_a_hot_user(spark):
    """One user has a third of all rows, spread over all partitions; order is by seq, not input."""
    random.seed(5)
    rows = [(0 if i % 3 == 0 else i % 40 + 1, s, f"s{s}", random.choice(["Accepted", "No"]))
            for i, s in enumerate(random.sample(range(10_000), 3000))]
    frame = submissions(spark, rows).repartition(16)
    expected = []
    for user in {r[0] for r in rows}:
        expected += sorted(r for r in rows if r[0] == user)[:25]
    assert values(select.first_n(frame, 25)) == ordered(expected)
    assert select.first_n(frame, None).count() == len(rows)


def test_limit_comes_before_the_status_filter(spark):
    rows = [(1, 1, "a", "No"), (1, 2, "b", "Accepted"), (1, 3, "c", "Accepted")]
    frame = select.accepted(select.first_n(submissions(spark, rows), 2))
    assert values(frame, "seq") == [(2,)]


def test_first_per_item_goes_by_list_order(spark):
    rows = [(1, 5, "a", "late"), (1, 2, "a", "early"), (1, 3, "b", "x"), (2, 9, "a", "y")]
    assert values(select.first_per_item(submissions(spark, rows))) == [
        (1, 2, "a", "early"), (1, 3, "b", "x"), (2, 9, "a", "y"),
    ]


def test_items_without_metadata_drop_out(spark):
    catalogue = spark.createDataFrame([("a", "A")], "title_slug string, title string")
    rows = [(1, 1, "a", "x"), (1, 2, "b", "x")]
    joined = select.with_items(submissions(spark, rows), catalogue)
    assert values(joined, "s.title_slug", "d.title") == [("a", "A")]


def test_daily_count_defaults_to_zero(spark):
    rows = problems(spark, [(1, "Easy", [], 1), (1, "Easy", [], 2), (1, "Easy", [], None)])
    days = rows.filter("seq = 0").select("user_id", F.col("date_solved").alias("date"), F.lit(7).alias("n"))
    assert values(select.with_daily_count(rows, days), "seq", "daily_count") == [(0, 7), (1, 0), (2, 0)]


def test_new_items_compare_titles_per_user(spark):
    schema = "user_id bigint, title string, x int"
    fetched = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (2, "A", 3), (1, "B", 4)], schema)
    existing = spark.createDataFrame([(1, "A"), (1, "A"), (1, None)], "user_id bigint, title string")
    assert values(select.new_items(fetched, existing), "x") == [(2,), (3,), (4,)]


def test_append_keeps_duplicates_and_fills_columns(spark):
    a = spark.createDataFrame([(1, "A")], "user_id int, title string")
    b = spark.createDataFrame([(1, "A", 5)], "user_id int, title string, x int")
    assert values(select.append_rows(a, b)) == [(1, "A", 5), (1, "A", None)]


def test_retention_drops_undated_rows(spark):
    rows = problems(spark, [(1, "Easy", [], d) for d in (1, 5, 6, 20, None)])
    kept = select.retained(rows, dt.date(2024, 1, 15), 10)
    assert values(kept, "seq") == [(1,), (2,), (3,)]
