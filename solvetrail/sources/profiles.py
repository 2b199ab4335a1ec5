"""User records: profile, contest standing and solved counts by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvetrail.functions.levels import LEVELS, percent
from solvetrail.sources.bodies import Opened, fault, parsed, rejected, strict

# Field names fixed by the landed format.
_LEVEL_COUNT = "array<struct<difficulty:string, count:bigint, submissions:bigint>>"
USER_BODY = (
    "matchedUser struct<username:string, "
    "profile:struct<realName:string, countryName:string, starRating:double, ranking:bigint, "
    "reputation:bigint>, "
    f"submitStats:struct<acSubmissionNum:{_LEVEL_COUNT}, totalSubmissionNum:{_LEVEL_COUNT}>, "
    "badges:array<struct<displayName:string, category:string, icon:string>>>, "
    "userContestRanking struct<attendedContestsCount:bigint, rating:double, globalRanking:bigint>"
)


def _figure(counts: Column, name: str, field: str) -> Column:
    """A level's figure; if a level is listed twice the last entry counts."""
    listed = F.filter(counts, lambda c: F.lower(c["difficulty"]) == name.lower())
    return F.coalesce(F.try_element_at(listed, F.lit(-1))[field], F.lit(0).cast("bigint"))


def read_users(spark: SparkSession, path: str) -> Opened:
    """User records out of landed lines (user_id, body), and the bodies that could not be read."""
    return opened(spark.read.schema("user_id bigint, body string").json(path))


def opened(payloads: DataFrame) -> Opened:
    """Bodies (user_id, body): one row per user, and the bodies that can't be read.

    A user the service does not know has a row of zeros; one whose body can't be read has none.
    """
    body, reason = _body(payloads)
    users = _users(body.filter(reason.isNull()).select("user_id", "found"))
    return Opened(users, rejected(body, "profiles", F.col("user_id"), reason, F.col("body")))


def from_payloads(payloads: DataFrame) -> DataFrame:
    """The users of bodies that can all be read; one that can't makes the query fail."""
    body, reason = _body(payloads)
    return _users(body.select("user_id", strict(F.col("found"), F.col("user_id"), reason).alias("found")))


def _body(payloads: DataFrame) -> tuple[DataFrame, Column]:
    body = parsed(payloads, USER_BODY, "user_id")
    return body, fault(F.col("body"), F.col("found"))


def _users(found: DataFrame) -> DataFrame:
    body = found.select("user_id", F.col("found.matchedUser").alias("u"), F.col("found.userContestRanking").alias("c"))
    accepted = F.col("u.submitStats.acSubmissionNum")
    solved = [_figure(accepted, n, "count").alias(f"{n.lower()}_solved") for n in LEVELS]
    submitted = [_figure(accepted, n, "submissions") for n in LEVELS]
    attempted = [
        _figure(F.col("u.submitStats.totalSubmissionNum"), n, "count").alias(f"{n.lower()}_total")
        for n in LEVELS
    ]
    badges = F.transform(
        "u.badges",
        lambda b: F.struct(
            F.coalesce(b["displayName"], F.lit("")).alias("name"),
            F.coalesce(b["category"], F.lit("")).alias("category"),
            F.coalesce(b["icon"], F.lit("")).alias("icon"),
        ),
    )
    no_badges = F.array().cast("array<struct<name:string, category:string, icon:string>>")
    flat = body.select(
        "user_id",
        F.coalesce("u.username", F.lit("")).alias("username"),
        F.coalesce("u.profile.realName", F.lit("")).alias("real_name"),
        F.coalesce("u.profile.countryName", F.lit("")).alias("country"),
        F.coalesce("u.profile.starRating", F.lit(0.0)).alias("star_rating"),
        F.coalesce("u.profile.ranking", F.lit(0)).alias("ranking"),
        F.coalesce("u.profile.reputation", F.lit(0)).alias("reputation"),
        *solved,
        *attempted,
        (submitted[0] + submitted[1] + submitted[2]).alias("total_submissions"),
        F.coalesce("c.rating", F.lit(0.0)).alias("contest_rating"),
        F.coalesce("c.globalRanking", F.lit(0)).alias("contest_rank"),
        F.coalesce("c.attendedContestsCount", F.lit(0)).alias("contests_attended"),
        F.coalesce(badges, no_badges).alias("badges"),
    )
    total = F.col("easy_solved") + F.col("medium_solved") + F.col("hard_solved")
    return flat.withColumn("total_solved", total).withColumn(
        "acceptance_rate", percent(F.col("total_solved"), F.col("total_submissions"))
    )
