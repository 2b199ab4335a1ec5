"""Counts per day, and the progress table on top of them.

Rows are counted per user and day first. The windows after that see one row per
user and day, so even the busiest user is a few thousand rows there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvetrail.functions.dates import month_start, week_start
from solvetrail.operators.streaks import running_streaks


def day_counts(rows: DataFrame) -> DataFrame:
    """Rows per user and day; undated rows form a cell with a NULL date."""
    return rows.groupBy("user_id", F.col("date_solved").alias("date")).agg(
        F.count("*").alias("daily_count")
    )


def level_days(rows: DataFrame) -> DataFrame:
    """Rows per user, day and level as `n`, dealt out by user: one input for the metrics of a user.

    It has the columns `user_id`, `date_solved` and `difficulty` of the rows it stands for. A user has at most
    a few rows per day here, so what follows needs no further shuffle.
    """
    cells = rows.groupBy("user_id", "date_solved", "difficulty").agg(F.count("*").alias("n"))
    return cells.repartition("user_id")


def days_of_levels(cells: DataFrame) -> DataFrame:
    """`day_counts` of the rows that the cells of `level_days` stand for."""
    return cells.groupBy("user_id", F.col("date_solved").alias("date")).agg(F.sum("n").alias("daily_count"))


def dated_days(days: DataFrame) -> DataFrame:
    return days.filter(F.col("date").isNotNull())


def add_day_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Day counts of two disjoint sets of rows together."""
    columns = ["user_id", "date", "daily_count"]
    both = old.select(*columns).unionByName(new.select(*columns))
    return both.groupBy("user_id", "date").agg(F.sum("daily_count").alias("daily_count"))


def progress(days: DataFrame, streak_rule: str | None = None) -> DataFrame:
    """Per day: its count, its week's and month's totals, the running total and the streak.

    The streak is 0, or with a rule the length of the run of days that the day's first row is in.
    Ordered by (week, date), which is the order by date, the running total and the week
    totals share one sort.
    """
    rows = dated_days(days)
    streak = F.lit(0).cast("bigint")
    if streak_rule:
        rows, streak = running_streaks(rows, streak_rule), F.col("streak")
    keyed = rows.select(
        "user_id",
        "date",
        "daily_count",
        streak.alias("streak"),
        week_start(F.col("date")).alias("week"),
        month_start(F.col("date")).alias("month"),
    )
    so_far = Window.partitionBy("user_id").orderBy("week", "date")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, 0)
    week, month = Window.partitionBy("user_id", "week"), Window.partitionBy("user_id", "month")
    return keyed.select(
        "user_id",
        "date",
        "daily_count",
        F.sum("daily_count").over(week).alias("weekly_count"),
        F.sum("daily_count").over(month).alias("monthly_count"),
        F.sum("daily_count").over(so_far).alias("total_solved"),
        "streak",
    )


def weeks(days: DataFrame) -> DataFrame:
    return _periods(days, week_start(F.col("date")))


def months(days: DataFrame) -> DataFrame:
    return _periods(days, month_start(F.col("date")))


def _periods(days: DataFrame, start) -> DataFrame:
    return (
        dated_days(days)
        .groupBy("user_id", start.alias("period_start"))
        .agg(F.sum("daily_count").alias("n"))
    )
