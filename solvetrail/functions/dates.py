"""Dates out of epoch seconds or text, and the calendar keys built on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from solvetrail.functions.text import whole_number

# Epoch seconds of 0001-01-01 and of the last second of 9999.
_FIRST_SECOND, _LAST_SECOND = -62135596800, 253402300799


def epoch_seconds(text: Column) -> Column:
    """Epoch seconds given as text; NULL when they name no date."""
    seconds = whole_number(text)
    return F.when(seconds.between(_FIRST_SECOND, _LAST_SECOND), seconds)


def epoch_date(text: Column) -> Column:
    """The UTC date of epoch seconds given as text, whatever the session's zone."""
    days = F.floor(epoch_seconds(text) / F.lit(86400)).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def epoch_hour(text: Column) -> Column:
    """The UTC hour of day, 0 to 23."""
    return F.floor(F.pmod(epoch_seconds(text), F.lit(86400)) / F.lit(3600)).cast("int")


def written_date(text: Column) -> Column:
    """Year-month-day text to a date; NULL for any other text or a day that does not exist."""
    shaped = text.rlike(r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$")
    return F.when(shaped, F.try_to_timestamp(text, F.lit("yyyy-M-d"))).cast("date")


def week_start(date: Column) -> Column:
    return F.trunc(date, "week")


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def weekday_name(date: Column) -> Column:
    return F.date_format(date, "EEEE")


def utc(moment: dt.datetime) -> dt.datetime:
    """A moment without zone is one in UTC, whatever the zone of the machine."""
    return moment.replace(tzinfo=dt.timezone.utc) if moment.tzinfo is None else moment
