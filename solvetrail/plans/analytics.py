"""All analytics of a set of clean rows, as lazy frames over two shared inputs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvetrail.operators import daily, difficulty, patterns, streaks, topics
from solvetrail.sources.mapping import Mapping


@dataclass(frozen=True)
class Analytics:
    """Every frame is lazy; take the ones needed. `days` is what most of them start from."""

    topics: DataFrame
    days: DataFrame
    progress: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Metrics:
    """The progress metrics of one set of rows."""

    daily_progress: DataFrame
    summary: DataFrame
    weekdays: DataFrame
    best_weekday: DataFrame
    difficulty_history: DataFrame
    monthly_levels: DataFrame
    level_shares: DataFrame
    complexity_trend: DataFrame


def _totals() -> list[Column]:
    """Two aggregates over day counts: all rows, and those with a date."""
    dated = F.when(F.col("date").isNotNull(), F.col("daily_count")).otherwise(0)
    return [F.sum("daily_count").alias("total_problems"), F.sum(dated).alias("total_solved")]


def summary(days: DataFrame, as_of: dt.date, rule: str = "row") -> DataFrame:
    """Per user the totals and both streaks, in one pass over the days."""
    running = streaks.running_streaks(days, rule)
    return running.groupBy("user_id").agg(*_totals(), *streaks.current_and_longest(as_of))


def analytics(
    rows: DataFrame, as_of: dt.date, mapping: Mapping | None = None, rule: str = "row", streak_rule: str | None = None
) -> Analytics:
    """What the result tables are made of; with a `streak_rule` the progress has running streaks."""
    days = daily.day_counts(rows)
    return Analytics(
        topics=topics.topic_totals(rows, mapping),
        days=days,
        progress=daily.progress(days, streak_rule),
        summary=summary(days, as_of, rule),
    )


def metrics(rows: DataFrame, as_of: dt.date, rule: str = "row") -> Metrics:
    """All progress metrics of the solved set; `seq` orders the rows of one day.

    All but the history and the trend's boundary day start from one set of counts per user, day and level.
    """
    cells = daily.level_days(rows)
    days = daily.days_of_levels(cells)
    return Metrics(
        daily_progress=daily.progress(days),
        summary=summary(days, as_of, rule),
        weekdays=patterns.weekdays(days),
        best_weekday=patterns.best_weekday(days),
        difficulty_history=patterns.difficulty_history(rows),
        monthly_levels=difficulty.monthly_levels(cells, "n"),
        level_shares=difficulty.level_shares(cells, "n"),
        complexity_trend=difficulty.complexity_trend(rows, cells=cells),
    )
