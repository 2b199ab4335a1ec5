"""Submission lists and submission calendars as landed JSON bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvetrail.functions.dates import epoch_date
from solvetrail.functions.tags import json_map
from solvetrail.functions.text import has_text
from solvetrail.sources.bodies import Opened, fault, parsed, rejected, strict

# Field names fixed by the landed format.
LIST_BODY = (
    "recentSubmissionList array<struct<title:string, titleSlug:string, timestamp:string, "
    "statusDisplay:string, lang:string, runtime:string, memory:string>>"
)
CALENDAR_BODY = "matchedUser struct<userCalendar:struct<submissionCalendar:string>>"


# What a landing zone holds per line: whose body it is, and where in the list it starts.
PAGES = "user_id bigint, offset bigint, body string"
USER_BODIES = "user_id bigint, body string"


def read_pages(spark: SparkSession, path: str) -> Opened:
    """Submissions out of landed list pages, and the pages that could not be read."""
    return opened(spark.read.schema(PAGES).json(path))


def read_calendars(spark: SparkSession, path: str) -> Opened:
    """Calendar days out of landed calendar bodies, and the calendars that could not be read."""
    return opened_calendars(spark.read.schema(USER_BODIES).json(path))


def opened(payloads: DataFrame) -> Opened:
    """Rows (user_id, offset, body), one per landed page: their submissions, and the pages that can't be read.

    A page that is JSON but has no list is one that can't be read; an empty list is a page without rows.
    """
    page, key, reason = _page(payloads)
    rows = _listed(page, F.when(reason.isNull(), F.col("found.recentSubmissionList")))
    return Opened(rows, rejected(page, "submissions", key, reason, F.col("body")))


def from_payloads(payloads: DataFrame) -> DataFrame:
    """The submissions of pages that can all be read; a page that can't makes the query fail."""
    page, key, reason = _page(payloads)
    return _listed(page, strict(F.col("found.recentSubmissionList"), key, reason))


def _page(payloads: DataFrame) -> tuple[DataFrame, Column, Column]:
    page = parsed(payloads, LIST_BODY, "user_id", "offset")
    found = F.col("found")
    no_list = F.when(found["recentSubmissionList"].isNull(), "no list")
    return page, F.concat_ws("/", "user_id", "offset"), F.coalesce(fault(F.col("body"), found), no_list)


def _listed(page: DataFrame, rows: Column) -> DataFrame:
    """A page holds the rows of a user's list from position `offset` on, so the position inside the page
    gives `seq` without ranking anything."""
    return page.select("user_id", "offset", F.posexplode(rows).alias("pos", "row")).select(
        "user_id",
        (F.col("offset") + F.col("pos")).alias("seq"),
        F.col("row.title").alias("title"),
        F.col("row.titleSlug").alias("title_slug"),
        F.col("row.timestamp").alias("timestamp"),
        F.col("row.statusDisplay").alias("status"),
        F.col("row.lang").alias("language"),
        F.col("row.runtime").alias("runtime"),
        F.col("row.memory").alias("memory"),
    )


def opened_calendars(payloads: DataFrame) -> Opened:
    """Rows (user_id, body): calendar days, and the bodies and calendar cells that can't be read."""
    body = parsed(payloads, CALENDAR_BODY, "user_id")
    cell = F.col("found.matchedUser.userCalendar.submissionCalendar")
    reason = F.coalesce(fault(F.col("body"), F.col("found")), F.when(bad_calendar(cell), "calendar"))
    days = calendar_days(body.select("user_id", cell.alias("calendar")))
    return Opened(days, rejected(body, "calendars", F.col("user_id"), reason, F.col("body")))


def bad_calendar(calendar: Column) -> Column:
    """True for a calendar cell with text that is no map from seconds to counts; never NULL."""
    return has_text(calendar) & json_map(calendar, "bigint").isNull()


def calendars_from_payloads(payloads: DataFrame) -> DataFrame:
    """Rows (user_id, body) to (user_id, calendar); the calendar stays JSON text."""
    cell = F.from_json("body", CALENDAR_BODY)["matchedUser"]["userCalendar"]
    return payloads.select("user_id", cell["submissionCalendar"].alias("calendar"))


def calendar_days(calendars: DataFrame) -> DataFrame:
    """Calendars (user_id, calendar) to one row (user_id, date, n) per day.

    Two entries of one day do not add up: the one written last wins.
    """
    entries = F.map_entries(json_map(F.col("calendar"), "bigint"))
    return (
        calendars.select("user_id", F.posexplode(entries).alias("pos", "entry"))
        .select("user_id", "pos", epoch_date(F.col("entry.key")).alias("date"), "entry.value")
        .filter(F.col("date").isNotNull())
        .groupBy("user_id", "date")
        .agg(F.max_by("value", "pos").alias("n"))
    )
