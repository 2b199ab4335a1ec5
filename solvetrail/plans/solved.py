"""The solved items: one row per user and item, with the item's metadata; and their clean form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvetrail.functions.dates import epoch_date, written_date
from solvetrail.functions.levels import level
from solvetrail.functions.text import clean_list, number, number_with_unit, strip, truth, whole_number
from solvetrail.operators import patterns, select
from solvetrail.sources.mapping import Mapping, with_categories


def accepted_submissions(submissions: DataFrame, limit: int | None = None) -> DataFrame:
    """A user's accepted submissions with their date; with a limit, those among the first `limit`."""
    rows = select.accepted(select.first_n(submissions, limit))
    return rows.withColumn("date_solved", epoch_date(F.col("timestamp")))


def solved(
    submissions: DataFrame, catalogue: DataFrame, limit: int | None = None, count_attempts: bool = False
) -> DataFrame:
    """The solved set; with a limit, of each user's first `limit` submissions of any status.

    `attempts` is 1, or if they are counted the user's submissions of any status for the item.
    """
    taken = select.first_n(submissions, limit)
    rows = select.with_slug(select.accepted(taken))
    first = select.first_per_item(
        rows.select("user_id", "title_slug", "seq", "timestamp", "language", "runtime", "memory")
    )
    tries = F.lit(1).cast("bigint")
    if count_attempts:
        first, tries = first.join(patterns.attempts(taken), ["user_id", "title_slug"]), F.col("s.attempts")
    return select.with_items(first, catalogue).select(
        "s.user_id",
        "s.seq",
        "d.title",
        "d.problem_id",
        "s.title_slug",
        "d.difficulty",
        "d.topics",
        "d.companies",
        epoch_date(F.col("s.timestamp")).alias("date_solved"),
        "s.language",
        number_with_unit(F.col("s.runtime")).alias("runtime"),
        number_with_unit(F.col("s.memory")).alias("memory"),
        F.lit("").alias("submission_id"),
        "d.is_paid_only",
        "d.category",
        number_with_unit(F.col("d.acceptance_rate")).alias("acceptance_rate"),
        tries.alias("attempts"),
        F.lit("Solved").alias("status"),
        *(["d.categories"] if "categories" in catalogue.columns else []),
    )


def catalogue_with_categories(catalogue: DataFrame, mapping: Mapping) -> DataFrame:
    """Items with the categories of their topics, so that solved rows carry them and meet no mapping later."""
    return with_categories(catalogue.withColumn("topics", clean_list(F.col("topics"))), mapping)


def validated(rows: DataFrame) -> DataFrame:
    """Cleaned rows; columns beyond the known ones pass through. Rows without a title are dropped.

    A column that already has its type is left as it is; texts are parsed, and what
    cannot be parsed becomes the default.
    """
    types = dict(rows.dtypes)
    text = ("title", "problem_id", "title_slug", "language", "submission_id", "category", "status")
    cleaned: dict[str, Column] = {name: strip(F.col(name)) for name in text if name in types}
    for name in ("topics", "companies"):
        if name in types:
            cleaned[name] = clean_list(F.col(name))
    if types.get("date_solved") == "string":
        cleaned["date_solved"] = written_date(strip(F.col("date_solved")))
    if types.get("acceptance_rate") == "string":
        cleaned["acceptance_rate"] = number(strip(F.col("acceptance_rate")))
    if "acceptance_rate" in types:
        rate = cleaned.get("acceptance_rate", F.col("acceptance_rate"))
        cleaned["acceptance_rate"] = F.coalesce(rate, F.lit(0.0))
    if types.get("attempts") == "string":
        cleaned["attempts"] = whole_number(F.col("attempts"), 1)
    elif "attempts" in types:
        cleaned["attempts"] = F.coalesce(F.col("attempts"), F.lit(1)).cast("bigint")
    if "status" in types:
        cleaned["status"] = F.coalesce(cleaned["status"], F.lit("Solved"))
    if "is_paid_only" in types:
        cleaned["is_paid_only"] = truth(F.col("is_paid_only"))
    cleaned["difficulty"] = level(F.col("difficulty"))
    return select.with_title(rows).withColumns(cleaned)
