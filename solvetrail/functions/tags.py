"""Names and figures inside the JSON cells of the item metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _empty() -> Column:
    return F.array().cast("array<string>")


def json_map(text: Column, values: str = "string") -> Column:
    """JSON object to a map; NULL for text that is not JSON."""
    return F.from_json(text, f"map<string,{values}>")


def names(text: Column, field: str) -> Column:
    """The given field of every object in a JSON list; a missing field is an empty name."""
    tags = F.from_json(text, f"array<struct<{field}:string>>")
    return F.transform(tags, lambda t: F.coalesce(t[field], F.lit("")))


def topic_names(text: Column) -> Column:
    return F.coalesce(F.when(_is_list(text), names(text, "name")), _empty())


def company_names(text: Column) -> Column:
    """Company names out of either shape: a list, or an object with the list under 'stats'."""
    wrapped = F.from_json(text, "stats string")["stats"]
    found = F.when(_is_list(text), names(text, "tagName")).when(
        _is_list(wrapped), names(wrapped, "tagName")
    )
    return F.coalesce(found, _empty())


def stats(text: Column) -> Column:
    """The three figures of the stats cell; test the fields for NULL, not the struct."""
    return F.from_json(text, "acRate string, totalAccepted string, totalSubmission string")


def _is_list(text: Column) -> Column:
    return text.rlike(r"^\s*\[")
