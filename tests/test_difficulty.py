import random

import pytest
from helpers import ROWS, day, problems, ordered, values
from pyspark.sql import functions as F

from solvetrail.operators import changes, difficulty, patterns

SCORES = {"Easy": 1, "Medium": 2, "Hard": 3, "Unknown": 0}


def test_monthly_levels(spark):
    rows = problems(spark, [(1, "Easy", [], 1), (1, "Unknown", [], 2), (1, "Unknown", [], 40), (1, "Hard", [], None)])
    assert values(difficulty.monthly_levels(rows)) == [(1, "2024-01", 1, 0, 0)]


def test_level_shares_divide_by_all_dated_rows(spark):
    rows = problems(spark, [(1, "Easy", [], 1), (1, "Unknown", [], 2), (1, "Hard", [], 3), (1, "Hard", [], 4), (1, "Hard", [], None)])
    assert values(difficulty.level_shares(rows)) == [(1, 0.25, 0.0, 0.5)]


def trend(spark, names):
    rows = problems(spark, [(1, n, [], i + 1) for i, n in enumerate(names)])
    return difficulty.complexity_trend(rows).first()


@pytest.mark.parametrize(
    "names, expected",
    [
        (["Easy"] * 9, difficulty.TOO_FEW),
        (["Easy"], difficulty.TOO_FEW),
        (["Easy"] * 10, difficulty.SAME),
        (["Easy"] * 5 + ["Medium"] * 5, difficulty.HARDER),
        (["Hard"] * 5 + ["Medium"] * 5, difficulty.EASIER),
        (["Easy"] * 5 + ["Unknown"] * 5, difficulty.EASIER),
        # Means 1.0 and 1.2: exactly the band, so no change.
        (["Easy"] * 5 + ["Easy"] * 4 + ["Medium"], difficulty.SAME),
    ],
)
def test_trend(spark, names, expected):
    assert trend(spark, names)["trend"] == expected


def test_eleven_rows_split_into_five_and_six(spark):
    row = trend(spark, ["Easy"] * 5 + ["Hard"] * 6)
    assert (row["first_avg"], row["second_avg"]) == (1.0, 3.0)


def test_undated_rows_are_left_out(spark):
    rows = problems(spark, [(1, "Easy", [], i) for i in range(1, 10)] + [(1, "Hard", [], None)] * 5)
    assert difficulty.complexity_trend(rows).first()["trend"] == difficulty.TOO_FEW
    assert difficulty.complexity_trend(rows.filter("date_solved is null")).isEmpty()


def halved(rows):
    """The halves of one user's rows (date, seq, slug, level), by sorting them."""
    rows = sorted(r for r in rows if r[0] is not None)
    return rows[: len(rows) // 2], rows[len(rows) // 2 :]


@pytest.mark.parametrize("day_rows, splits", [(difficulty.DAY_ROWS, difficulty.SPLITS), (20, 8), (1, 1000)])
@pytest.mark.parametrize("one_seq", [False, True])
def test_halves_with_hot_users_and_days(spark, day_rows, splits, one_seq):
    """User 0 holds a third of all rows, most of them on one day; seq spans the bigint range or is the same."""
    random.seed(3)
    users = {}
    for i in range(3000):
        user = 0 if i % 3 == 0 else random.randint(1, 60)
        date = day(15) if user == 0 and i % 4 else day(random.randint(1, 30))
        if random.random() < 0.05:
            date = None
        wide = 2**62 if random.random() < 0.5 else 2**20
        seq = 7 if one_seq else random.randint(-wide, wide)
        users.setdefault(user, []).append((date, seq, f"s{i}", random.choice(list(SCORES))))
    data = [(u, q, "T", s, n, [], d) for u, rows in users.items() for d, q, s, n in rows]
    frame = spark.createDataFrame(data, ROWS).repartition(8)
    expected_halves, expected_trend = [], []
    for user, rows in users.items():
        first, second = halved(rows)
        expected_halves += [(user, r[2], r[0], half) for half, part in ((1, first), (2, second)) for r in part]
        if len(first) + len(second) >= 10:
            means = [sum(SCORES[r[3]] for r in part) / len(part) for part in (first, second)]
            expected_trend.append((user, *means))
    assert values(difficulty.halves(frame, day_rows, splits)) == ordered(expected_halves)
    found = difficulty.complexity_trend(frame, day_rows, splits).filter(F.col("first_avg").isNotNull())
    assert values(found, "user_id", "first_avg", "second_avg") == ordered(expected_trend)


def test_long_day_is_cut_into_short_stretches(spark):
    """Of 20,000 rows of one day and one seq at most a twentieth is put in order."""
    rows = spark.range(20_000).select(
        F.lit(1).alias("user_id"), F.lit(day(1)).alias("date_solved"), F.lit(5).alias("seq"),
        F.concat(F.lit("item-"), F.format_string("%06d", "id")).alias("title_slug"), F.lit("Hard").alias("difficulty"),
    )
    dated = difficulty._dated(rows)
    edge = dated.join(difficulty._days(dated).filter(difficulty._ON_DAY), ["user_id", "date"])
    assert difficulty._stretch(edge, difficulty.SPLITS).count() <= 1_000
    found = difficulty.middle_rows(rows, 1_000).first()
    assert (found.rows, found.title_slug, found.first_sum) == (20_000, "item-009999", 30_000)


def test_difficulty_history(spark):
    rows = problems(spark, [(1, "Easy", [], 2), (1, "Unknown", [], 1), (1, "Hard", [], None)])
    assert values(patterns.difficulty_history(rows)) == [(1, 0, day(2), "easy"), (1, 1, day(1), "unknown")]


def test_change_classes(spark):
    schema = "user_id int, title_slug string, x string"
    old = spark.createDataFrame([(1, "a", "1"), (1, "b", "1"), (1, "c", None)], schema)
    new = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (2, "c", None), (1, "d", "1")], schema)
    assert values(changes.changes(old, new, ["x"])) == [
        (1, "a", "unchanged"), (1, "b", "updated"), (1, "c", "missing"), (1, "d", "new"), (2, "c", "new"),
    ]
    assert values(changes.change_counts(old, new, ["x"])) == [
        ("missing", 1), ("new", 2), ("unchanged", 1), ("updated", 1),
    ]
