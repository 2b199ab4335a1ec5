"""Differences between two states of the solved items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, compared: list[str]) -> DataFrame:
    """Per (user, item) whether it is new, updated, unchanged or missing.

    Only the key and a hash of the compared columns are shuffled.
    """
    before = old.select("user_id", "title_slug", F.xxhash64(*compared).alias("old_hash"))
    after = new.select("user_id", "title_slug", F.xxhash64(*compared).alias("new_hash"))
    kind = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "missing")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("updated")
    )
    joined = before.join(after, ["user_id", "title_slug"], "full")
    return joined.select("user_id", "title_slug", kind.alias("change"))


def change_counts(old: DataFrame, new: DataFrame, compared: list[str]) -> DataFrame:
    return changes(old, new, compared).groupBy("change").agg(F.count("*").alias("n"))


def upserts(
    fetched: DataFrame,
    stored: DataFrame,
    key: list[str],
    title: list[str],
    compared: list[str],
    kept: list[str],
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The fetched rows that change the stored table, with `change`: new or updated.

    New is a row whose title (columns `title`) is not stored. Updated is one that is stored under its `key` with
    other `compared` cells; it takes over the stored row's `kept` cells. All other rows change nothing. The
    stored rows are first cut down to the fetched titles, so with a small batch they are not shuffled. What is
    left of them is read twice; `stage` writes it, so that they are cut down once and Spark knows how few they are.
    """
    titles = fetched.select(*title).distinct()
    known = stored.select(*key, *kept, F.xxhash64(*compared).alias("old_hash")).join(titles, title, "left_semi")
    known = stage(known) if stage else known
    there = known.select(*title, F.lit(True).alias("there")).distinct()
    same = known.dropDuplicates(key).select(*key, "old_hash", F.struct(*kept).alias("stored"))
    joined = fetched.join(there, title, "left").join(same, key, "left")
    updated = F.col("old_hash") != F.xxhash64(*compared)
    change = F.when(F.col("there").isNull(), "new").when(updated, "updated")
    cells = [F.when(F.col("there").isNull(), F.col(c)).otherwise(F.col("stored")[c]).alias(c) if c in kept else F.col(c) for c in fetched.columns]
    return joined.withColumn("change", change).filter(F.col("change").isNotNull()).select(*cells, "change")


def differences(old: DataFrame, new: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """One row: how many keys of `new` are new and updated against `old`, and how many of `old` are missing.

    Rows may share a key: then how many there are and all their compared cells count. Only keys and
    hashes are shuffled.
    """
    state = lambda rows: rows.groupBy(*key).agg(F.struct(F.count("*"), F.bit_xor(F.xxhash64(*compared))).alias("state"))
    joined = state(old).withColumnRenamed("state", "before").join(state(new).withColumnRenamed("state", "after"), key, "full")
    before, after = F.col("before"), F.col("after")
    return joined.agg(
        F.count_if(before.isNull()).alias("new"),
        F.count_if(before != after).alias("updated"),
        F.count_if(after.isNull()).alias("missing"),
    )
