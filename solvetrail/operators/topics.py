"""Statistics per user and topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvetrail.functions.dates import month_start
from solvetrail.functions.levels import counts_by_level, score, share
from solvetrail.sources.mapping import Mapping, with_categories


def topic_totals(rows: DataFrame, mapping: Mapping | None = None) -> DataFrame:
    """Per topic: rows, rows by level and the latest date. Without a mapping a topic an
    item names twice counts twice; with one, an item counts once per category. Rows that carry
    `categories` already are counted by those."""
    carried = "categories" in rows.columns
    if not carried:
        rows = with_categories(rows.select("user_id", "difficulty", "date_solved", "topics"), mapping)
    cells = ("user_id", "difficulty", "date_solved")
    if carried or not mapping:
        each = rows.select(*cells, F.explode("categories").alias("topic"))
    else:
        # The inner explode would make the join an inner one: then Spark may broadcast the rows and let the few
        # lists of topics meet them, all in one task.
        each = rows.select(*cells, F.explode_outer("categories").alias("topic")).filter(F.col("topic").isNotNull())
    return (
        each
        .groupBy("user_id", "topic")
        .agg(
            F.count("*").alias("total"),
            *counts_by_level(F.col("difficulty")),
            F.max("date_solved").alias("last_solved"),
        )
        .select(
            "user_id", "topic", "total", F.col("total").alias("solved"),
            "easy", "medium", "hard", "last_solved",
        )
    )


def add_topic_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    """Totals of two disjoint sets of rows together: counts add up, the later date stays."""
    counts = ("total", "solved", "easy", "medium", "hard")
    columns = ["user_id", "topic", *counts, "last_solved"]
    return (
        old.select(*columns)
        .unionByName(new.select(*columns))
        .groupBy("user_id", "topic")
        .agg(*[F.sum(c).alias(c) for c in counts], F.max("last_solved").alias("last_solved"))
    )


def analytics_rows(totals: DataFrame) -> DataFrame:
    """The Analytics table: totals with the share solved."""
    return totals.select(
        "user_id",
        "topic",
        "total",
        "solved",
        share(F.col("solved"), F.col("total")).alias("percentage"),
        "last_solved",
        "easy",
        "medium",
        "hard",
    )


def topic_levels(rows: DataFrame) -> DataFrame:
    """Mean level score per topic and month."""
    return (
        rows.filter(F.col("date_solved").isNotNull())
        .select(
            "user_id",
            F.explode("topics").alias("topic"),
            month_start(F.col("date_solved")).alias("month"),
            score(F.col("difficulty")).alias("score"),
        )
        .groupBy("user_id", "topic", "month")
        .agg((F.sum("score") / F.count("*")).alias("avg_score"))
    )


def completion(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per topic a user has touched: items in the catalogue, items solved, and the share."""
    once = F.explode(F.array_distinct("topics")).alias("topic")
    available = catalogue.select(once).groupBy("topic").agg(F.count("*").alias("available"))
    solved = (
        rows.select("user_id", once).groupBy("user_id", "topic").agg(F.count("*").alias("solved"))
    )
    return solved.join(available, "topic", "left").select(
        "user_id",
        "topic",
        F.coalesce("available", F.lit(0)).alias("available"),
        "solved",
        share(F.col("solved"), F.col("available")).alias("percentage"),
    )
