"""Filters, the first-n and first-per-item choices, and the joins on submissions."""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvetrail.functions.text import has_text

# First-n ranks a user's rows in this many lanes before it ranks the survivors.
LANES = 256


def accepted(submissions: DataFrame) -> DataFrame:
    return submissions.filter(F.col("status") == "Accepted")


def with_slug(submissions: DataFrame) -> DataFrame:
    return submissions.filter(F.col("title_slug") != "")


def with_title(rows: DataFrame) -> DataFrame:
    return rows.filter(has_text(F.col("title")))


def dated(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("date_solved").isNotNull())


def retained(rows: DataFrame, as_of: dt.date, days: int = 365) -> DataFrame:
    """Rows of the last `days` days; undated rows go too."""
    return rows.filter(F.col("date_solved") >= F.lit(as_of - dt.timedelta(days=days)))


def first_n(submissions: DataFrame, n: int | None) -> DataFrame:
    """Each user's first n submissions in list order, of any status.

    Ranked twice: within (user, lane), where a lane is a group of input partitions, and
    then among the survivors, at most n per lane. A user with a large part of all rows is
    thereby spread over the lanes, and each map task already sends at most n rows per user.
    """
    if n is None:
        return submissions
    cut = submissions.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    if n > int(cut):
        warnings.warn(f"map tasks send all rows: set spark.sql.optimizer.windowGroupLimitThreshold to {n}", stacklevel=2)
    order = (F.col("seq"), F.col("title_slug"))
    by_lane = Window.partitionBy("user_id", "lane").orderBy(*order)
    by_user = Window.partitionBy("user_id").orderBy(*order)
    return (
        submissions.withColumn("lane", F.spark_partition_id() % LANES)
        .withColumn("rank", F.row_number().over(by_lane))
        .filter(F.col("rank") <= n)
        .withColumn("rank", F.row_number().over(by_user))
        .filter(F.col("rank") <= n)
        .drop("lane", "rank")
    )


def first_per_item(submissions: DataFrame) -> DataFrame:
    """One submission per user and item, the first in list order.

    Spark keeps one row per key in every map task before the shuffle, so repeats of an
    item cost nothing there. The other columns only settle rows of the same position.
    """
    rest = [c for c in submissions.columns if c not in ("user_id", "title_slug", "seq")]
    in_order = Window.partitionBy("user_id", "title_slug").orderBy("seq", *rest)
    ranked = submissions.withColumn("rank", F.row_number().over(in_order))
    return ranked.filter(F.col("rank") == 1).drop("rank")


def with_items(submissions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Submissions with the metadata of their item; items without metadata drop out.

    A catalogue under Spark's broadcast threshold is broadcast; beyond it this is a
    sort-merge join, whose hot items adaptive execution splits.
    """
    return submissions.alias("s").join(
        catalogue.alias("d"), F.col("s.title_slug") == F.col("d.title_slug"), "inner"
    )


def with_daily_count(submissions: DataFrame, days: DataFrame) -> DataFrame:
    """The calendar's count of the day on every submission, 0 where it has none."""
    renamed = days.withColumnRenamed("date", "date_solved")
    joined = submissions.join(renamed, ["user_id", "date_solved"], "left")
    return joined.withColumn("daily_count", F.coalesce("n", F.lit(0))).drop("n")


def new_items(fetched: DataFrame, existing: DataFrame) -> DataFrame:
    """Fetched rows whose title the user does not have yet.

    The existing titles are first cut down to those fetched. With a batch small enough to
    broadcast, the existing table is scanned where it lies and not shuffled.
    """
    key = ["user_id", "title"]
    known = existing.select(*key).join(fetched.select(*key), key, "left_semi")
    return fetched.join(known, key, "left_anti")


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of rows, duplicates kept; a column missing on one side is NULL there."""
    return existing.unionByName(new, allowMissingColumns=True)
