"""Difficulty levels, shares and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from solvetrail.functions.text import strip

LEVELS = ("Easy", "Medium", "Hard")


def level(text: Column) -> Column:
    """Easy, Medium or Hard in any case and with blanks around; else Unknown."""
    key = F.lower(strip(text))
    out = F
    for name in LEVELS:
        out = out.when(key == name.lower(), name)
    return out.otherwise("Unknown")


def score(text: Column) -> Column:
    """1, 2, 3 for the three levels, 0 for anything else."""
    key = F.lower(text)
    out = F
    for points, name in enumerate(LEVELS, 1):
        out = out.when(key == name.lower(), F.lit(points).cast("bigint"))
    return out.otherwise(F.lit(0).cast("bigint"))


def counts_by_level(difficulty: Column, n: Column | None = None) -> list[Column]:
    """Three aggregates: easy, medium, hard; with `n`, of rows that stand for so many."""
    key = F.lower(difficulty)
    if n is None:
        return [F.count_if(key == name.lower()).alias(name.lower()) for name in LEVELS]
    return [F.sum(F.when(key == name.lower(), n).otherwise(0)).alias(name.lower()) for name in LEVELS]


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """Percentage, 0 when there is nothing to divide by."""
    return F.coalesce(share(part, whole) * 100, F.lit(0.0))
