"""Daily progress, streaks and weekdays."""

import datetime as dt
import random

import pytest
from helpers import day, problems, values

from solvetrail.operators import daily, patterns, streaks
from solvetrail.plans import analytics


def counts(spark, days, user=1):
    return daily.day_counts(problems(spark, [(user, "Easy", [], d) for d in days]))


def test_progress(spark):
    frame = daily.progress(counts(spark, [1, 1, 7, 8, 31, 32, None]))
    columns = ("date", "daily_count", "weekly_count", "monthly_count", "total_solved", "streak")
    assert values(frame, *columns) == [
        (day(1), 2, 3, 5, 2, 0), (day(7), 1, 3, 5, 3, 0), (day(8), 1, 1, 5, 4, 0),
        (day(31), 1, 2, 5, 5, 0), (day(32), 1, 2, 1, 6, 0),
    ]


def test_day_counts_add_up(spark):
    both = daily.add_day_counts(counts(spark, [1, 2]), counts(spark, [2, 3]))
    assert values(both) == [(1, day(1), 1), (1, day(2), 2), (1, day(3), 1)]


def test_periods(spark):
    days = counts(spark, [1, 7, 8, 32])
    assert values(daily.weeks(days), "period_start", "n") == [(day(1), 2), (day(8), 1), (day(29), 1)]
    assert values(daily.months(days), "period_start", "n") == [(day(1), 3), (day(32), 1)]


def pair(spark, days, as_of, rule="row"):
    row = streaks.streaks(counts(spark, days), day(as_of), rule).first()
    return row["current_streak"], row["longest_streak"]


@pytest.mark.parametrize(
    "days, as_of, expected",
    [
        ([1, 2, 3], 3, (3, 3)),
        ([1, 2, 3], 4, (3, 3)),
        ([1, 2, 3], 5, (0, 3)),
        ([1, 2, 3], 2, (3, 3)),
        ([1, 2, 2, 3], 3, (2, 2)),
        ([1, 1, 2], 2, (2, 2)),
        ([1, 2, 2], 2, (1, 2)),
        ([1, 3], 3, (1, 1)),
        ([None], 3, (0, 0)),
        ([None, None, 1, 2], 2, (2, 2)),
    ],
)
def test_row_rule(spark, days, as_of, expected):
    assert pair(spark, days, as_of) == expected


@pytest.mark.parametrize(
    "days, as_of, expected",
    [([1, 2, 2, 3], 3, (3, 3)), ([1, 2, 4, 4], 5, (1, 2)), ([1, 2], 9, (0, 2)), ([None], 1, (0, 0))],
)
def test_day_rule(spark, days, as_of, expected):
    assert pair(spark, days, as_of, "day") == expected


def runs(days):
    """The row rule's runs as (first place, last place) in the ordered days: cut wherever two
    neighbours are not exactly one day apart."""
    ordered = sorted(days)
    cuts = [i for i in range(1, len(ordered)) if ordered[i] - ordered[i - 1] != 1]
    return ordered, list(zip([0, *cuts], [c - 1 for c in cuts] + [len(ordered) - 1], strict=True))


def expected_streaks(days, as_of):
    ordered, found = runs(days)
    longest = max(b - a + 1 for a, b in found)
    a, b = found[-1]
    return (b - a + 1 if ordered[b] >= as_of - 1 else 0), longest


def test_row_rule_against_listed_runs(spark):
    random.seed(11)
    users = {u: [random.randint(1, 25) for _ in range(random.randint(1, 30))] for u in range(300)}
    rows = [(u, "Easy", [], d) for u, ds in users.items() for d in ds]
    days = daily.day_counts(problems(spark, rows))
    found = {r["user_id"]: (r["current_streak"], r["longest_streak"])
             for r in streaks.streaks(days, day(24)).collect()}
    assert found == {u: expected_streaks(ds, 24) for u, ds in users.items()}
    running = streaks.running_streaks(days)
    longest = running.groupBy("user_id").max("streak").collect()
    assert {r[0]: r[1] for r in longest} == {u: expected_streaks(ds, 24)[1] for u, ds in users.items()}


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        streaks.running_streaks(counts(spark, [1]), "week")


def test_weekdays(spark):
    # 2024-01-01 was a Monday.
    days = counts(spark, [2, 9, 3, 10, None, 7])
    assert values(patterns.weekdays(days), "day_name", "n") == [("Sunday", 1), ("Tuesday", 2), ("Wednesday", 2)]
    assert values(patterns.best_weekday(days)) == [(1, "Tuesday")]


def test_weekday_tie_goes_to_the_earlier_date(spark):
    assert values(patterns.best_weekday(counts(spark, [5, 2]))) == [(1, "Tuesday")]
    assert values(patterns.best_weekday(counts(spark, [3, 9]))) == [(1, "Wednesday")]


def test_summary(spark):
    rows = problems(spark, [(1, "Easy", [], 1), (1, "Easy", [], 2), (1, "Easy", [], None), (2, "Easy", [], None)])
    found = analytics.analytics(rows, dt.date(2024, 1, 2))
    assert values(found.summary) == [(1, 3, 2, 2, 2), (2, 1, 0, 0, 0)]
    assert found.progress.count() == 2


def test_no_rows_give_no_metrics(spark):
    found = analytics.metrics(problems(spark, []), dt.date(2024, 1, 2))
    for name, frame in vars(found).items():
        assert frame.isEmpty(), name


def test_hours_and_attempts(spark):
    schema = "user_id bigint, title_slug string, timestamp string"
    rows = [(1, "a", "3600"), (1, "a", "7199"), (1, "b", "x")]
    frame = spark.createDataFrame(rows, schema)
    assert values(patterns.hours(frame)) == [(1, 1, 2)]
    assert values(patterns.attempts(frame)) == [(1, "a", 2), (1, "b", 1)]
