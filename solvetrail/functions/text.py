"""Cleaning of text cells and numbers written with a unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blanks, in code point order.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Most cells start and end with a printable ASCII character and need no change.
_CLEAN = r"(?s)^[!-~](?:.*[!-~])?\z"
# What counts as a number. Spark alone would also take '1d' or '0x1p3'.
_NUMBER = r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))"
# A number, then what may be cut off behind it: M and B, before them m and s, before them %.
_BLANK = r"[\s\x1c-\x1f]"
_NUMBER_WITH_UNIT = rf"(?U)^{_BLANK}*({_NUMBER}){_BLANK}*[MB]*[ms]*%*{_BLANK}*\z"


def strip(text: Column) -> Column:
    """Remove blanks of every kind from both ends."""
    return F.when(text.rlike(_CLEAN), text).otherwise(F.btrim(text, F.lit(BLANKS)))


def has_text(text: Column) -> Column:
    """True when something other than blanks is there; never NULL."""
    return F.coalesce(strip(text) != "", F.lit(False))


def number(text: Column) -> Column:
    """Text to double; NULL when it is not a plain number."""
    return F.when(text.rlike(rf"^{_NUMBER}\z"), text.try_cast("double"))


def number_with_unit(text: Column) -> Column:
    """'12 ms', '14.2 MB', '52.3%' to their number, anything else to 0.

    The unit is a run of characters, not a word: first '%' is cut off, then 'm' and 's',
    then 'M' and 'B'.
    """
    found = F.regexp_extract(text, _NUMBER_WITH_UNIT, 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def whole_number(text: Column, default: int | None = None) -> Column:
    """Text to bigint, the default when it is not a whole number."""
    # Spark's own cast takes care of the common blanks.
    rare = F.btrim(text, F.lit(BLANKS)).try_cast("bigint")
    value = F.coalesce(text.try_cast("bigint"), rare)
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def truth(value: Column) -> Column:
    """A flag; missing, and what is no flag, means false."""
    return F.coalesce(value.try_cast("boolean"), F.lit(False))


def join_list(items: Column) -> Column:
    """List to one text cell."""
    return F.coalesce(F.array_join(items, ", "), F.lit(""))


def split_list(text: Column) -> Column:
    """The way back; an empty or missing cell is an empty list."""
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(F.split(text, ", "))


def clean_list(items: Column) -> Column:
    """Drop missing members, strip the others."""
    kept = F.filter(items, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.transform(kept, strip), F.array().cast("array<string>"))
