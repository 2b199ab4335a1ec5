"""When and how a user solves: weekdays, hours, repeats, paid items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvetrail.functions.dates import epoch_hour, weekday_name
from solvetrail.operators.daily import dated_days


def weekdays(days: DataFrame) -> DataFrame:
    """Solved per weekday, weekdays that occur only; `first_date` settles ties."""
    return (
        dated_days(days)
        .groupBy("user_id", weekday_name(F.col("date")).alias("day_name"))
        .agg(F.sum("daily_count").alias("n"), F.min("date").alias("first_date"))
    )


def best_weekday(days: DataFrame) -> DataFrame:
    """The weekday with the highest count; of equals the one that occurred first."""
    best = Window.partitionBy("user_id").orderBy(F.desc("n"), "first_date")
    return (
        weekdays(days)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") == 1)
        .select("user_id", "day_name")
    )


def difficulty_history(rows: DataFrame) -> DataFrame:
    """One (date, difficulty) per dated row; (date, seq) is its order within the user."""
    return rows.filter(F.col("date_solved").isNotNull()).select(
        "user_id", "seq", F.col("date_solved").alias("date"), F.lower("difficulty").alias("difficulty")
    )


def hours(submissions: DataFrame) -> DataFrame:
    """Submissions with a time, per hour of the day."""
    timed = submissions.select("user_id", epoch_hour(F.col("timestamp")).alias("hour"))
    return (
        timed.filter(F.col("hour").isNotNull())
        .groupBy("user_id", "hour")
        .agg(F.count("*").alias("n"))
    )


def attempts(submissions: DataFrame) -> DataFrame:
    """Submissions of any status per user and item."""
    return submissions.groupBy("user_id", "title_slug").agg(F.count("*").alias("attempts"))


def paid_share(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "is_paid_only").agg(F.count("*").alias("n"))
