"""Streaks of consecutive days, from the day counts.

Two rules. The row rule counts rows: a second row on one day ends the run and starts a
new one. The day rule counts distinct days, however many rows they have.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_streaks(days: DataFrame, rule: str = "row") -> DataFrame:
    """Per day the run length on arrival (`streak`) and after its last row (`leave`).

    A run goes on when the day before has a count and, under the row rule, a count of
    one. Under the row rule the rows of a busy day end in a run of one, which the next
    day extends; so a run that starts right after a busy day starts at two.
    """
    by_date = Window.partitionBy("user_id").orderBy("date")
    follows = F.coalesce(F.date_diff("date", F.lag("date").over(by_date)) == 1, F.lit(False))
    if rule == "row":
        after_busy = F.lag("daily_count").over(by_date) > 1
        busy = F.col("daily_count") > 1
    elif rule == "day":
        after_busy, busy = F.lit(False), F.lit(False)
    else:
        raise ValueError(f"rule is 'row' or 'day', got {rule!r}")
    marked = days.select(
        "user_id",
        "date",
        "daily_count",
        F.row_number().over(by_date).alias("position"),
        F.when(~follows, 1).when(after_busy, 2).alias("opens_at"),
        busy.alias("busy"),
    )
    # The last day that opened a run: what its length is counted from.
    opened = F.when(F.col("opens_at").isNotNull(), F.col("position") - F.col("opens_at"))
    arrive = F.col("position") - F.last(opened, ignorenulls=True).over(
        by_date.rowsBetween(Window.unboundedPreceding, 0)
    )
    return marked.select(
        "user_id",
        "date",
        "daily_count",
        F.when(F.col("date").isNotNull(), arrive).cast("bigint").alias("streak"),
        "busy",
    ).select(
        "user_id",
        "date",
        "daily_count",
        "streak",
        F.when(F.col("busy"), F.lit(1).cast("bigint")).otherwise(F.col("streak")).alias("leave"),
    )


def current_and_longest(as_of: dt.date) -> list[Column]:
    """Two aggregates over running streaks, 0 and 0 without any date.

    A run is current if its last day is yesterday or later.
    """
    alive = F.max("date") >= F.lit(as_of - dt.timedelta(days=1))
    none = F.lit(0).cast("bigint")
    return [
        F.when(alive, F.max_by("leave", "date")).otherwise(none).alias("current_streak"),
        F.coalesce(F.max("streak"), none).alias("longest_streak"),
    ]


def streaks(days: DataFrame, as_of: dt.date, rule: str = "row") -> DataFrame:
    """Per user the current and the longest streak."""
    return running_streaks(days, rule).groupBy("user_id").agg(*current_and_longest(as_of))
