"""Landed JSON bodies: the rows that can be read, and what can't be with its key and the reason."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvetrail.functions.text import has_text

# The side table: where a body came from, whose it was, why it could not be read, and its text.
REJECTED = "source string, key string, reason string, body string"

# Why something was not read.
MISSING, UNREADABLE = "missing", "unreadable"

_BROKEN = "_broken"


class Opened(NamedTuple):
    """Rows out of landed bodies, and the bodies and cells that could not be read (REJECTED)."""

    rows: DataFrame
    rejected: DataFrame


def parsed(payloads: DataFrame, schema: str, *keys: str | Column) -> DataFrame:
    """The keys, `body`, and `found`: the JSON body under a schema; a broken one leaves its text in a field of its own.

    Exploding a list of one keeps Spark from parsing a body once more for every field that is taken out of it.
    """
    found = F.from_json("body", f"{schema}, {_BROKEN} string", {"columnNameOfCorruptRecord": _BROKEN})
    return payloads.select(*keys, "body", F.explode(F.array(found)).alias("found"))


def fault(body: Column, found: Column) -> Column:
    """Why a body could not be read; NULL for one that could."""
    broken = found.isNull() | found[_BROKEN].isNotNull()
    return F.when(body.isNull(), MISSING).when(broken, UNREADABLE)


def bad_cell(text: Column) -> Column:
    """True for a cell with text that is not JSON; never NULL."""
    return has_text(text) & F.try_parse_json(text).isNull()


def rejected(rows: DataFrame, source: str, key: Column, reason: Column, body: Column) -> DataFrame:
    """The rows with a reason as rows of the side table."""
    return rows.select(
        F.lit(source).alias("source"), key.cast("string").alias("key"), reason.alias("reason"), body.alias("body")
    ).filter(F.col("reason").isNotNull())


def strict(value: Column, key: Column, reason: Column) -> Column:
    """The value; a body that could not be read makes the query fail."""
    text = F.concat(F.lit("body of "), F.coalesce(key.cast("string"), F.lit("?")), F.lit(" is "), reason)
    return F.when(reason.isNull(), value).otherwise(F.raise_error(text))
