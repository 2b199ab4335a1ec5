"""Item metadata: landed JSON bodies, and the parsed catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvetrail.functions import tags
from solvetrail.functions.text import truth
from solvetrail.sources.bodies import Opened, bad_cell, fault, parsed, rejected, strict

# Field names fixed by the landed format.
ITEM_BODY = (
    "question struct<questionId:string, title:string, titleSlug:string, difficulty:string, "
    "topicTags:string, companyTagStats:string, stats:string, isPaidOnly:boolean, "
    "categoryTitle:string>"
)


# What a landing zone holds per line: which item was asked for, and the answer.
ITEM_BODIES = "title_slug string, body string"
# Cells of an item that are JSON text themselves.
CELLS = ("topic_tags", "company_tags", "stats")


def read_bodies(spark: SparkSession, path: str) -> Opened:
    """Landed item rows out of lines with one JSON body each, and what could not be read."""
    return opened(spark.read.schema(ITEM_BODIES).json(path))


def opened(payloads: DataFrame) -> Opened:
    """Rows (title_slug, body), or (body): rows of the landed item table, and what can't be read.

    Items not found (a body without an item) are dropped. An item with a JSON cell that can't be read stays,
    the cell counts as absent there and is listed by its name.
    """
    body, key, reason = _body(payloads)
    rows = _items(body.select(F.when(reason.isNull(), F.col("found.question")).alias("q")))
    bad = F.filter(F.array(*(F.when(bad_cell(F.col(name)), F.lit(name)) for name in CELLS)), lambda name: name.isNotNull())
    cells = rows.select("title_slug", F.explode(bad).alias("cell"), *CELLS)
    text = F.coalesce(*(F.when(F.col("cell") == name, F.col(name)) for name in CELLS))
    return Opened(
        rows,
        rejected(body, "items", key, reason, F.col("body")).unionByName(
            rejected(cells, "items", F.col("title_slug"), F.col("cell"), text)
        ),
    )


def from_payloads(payloads: DataFrame) -> DataFrame:
    """The items of bodies that can all be read; one that can't makes the query fail."""
    body, key, reason = _body(payloads)
    return _items(body.select(strict(F.col("found.question"), key, reason).alias("q")))


def _body(payloads: DataFrame) -> tuple[DataFrame, Column, Column]:
    key = F.col("title_slug") if "title_slug" in payloads.columns else F.lit(None).cast("string")
    body = parsed(payloads, ITEM_BODY, key.alias("key"))
    return body, F.col("key"), fault(F.col("body"), F.col("found"))


def _items(item: DataFrame) -> DataFrame:
    return item.filter(F.col("q.titleSlug").isNotNull()).select(
        F.col("q.questionId").alias("problem_id"),
        F.col("q.title").alias("title"),
        F.col("q.titleSlug").alias("title_slug"),
        F.col("q.difficulty").alias("difficulty"),
        F.col("q.topicTags").alias("topic_tags"),
        F.col("q.companyTagStats").alias("company_tags"),
        F.col("q.stats").alias("stats"),
        F.col("q.isPaidOnly").alias("is_paid_only"),
        F.col("q.categoryTitle").alias("category"),
    )


def catalogue(items: DataFrame) -> DataFrame:
    """Landed items with their JSON cells opened."""
    figures = items.withColumn("figures", tags.stats(F.col("stats")))
    return figures.select(
        "problem_id",
        "title",
        "title_slug",
        "difficulty",
        tags.topic_names(F.col("topic_tags")).alias("topics"),
        tags.company_names(F.col("company_tags")).alias("companies"),
        truth(F.col("is_paid_only")).alias("is_paid_only"),
        "category",
        F.coalesce("figures.acRate", F.lit("0")).alias("acceptance_rate"),
        F.coalesce("figures.totalAccepted", F.lit("0")).alias("total_accepted"),
        F.coalesce("figures.totalSubmission", F.lit("0")).alias("total_submissions"),
    )
