"""Backups: problem records as JSON rows, with a one-row manifest next to them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvetrail import schemas
from solvetrail.functions.dates import utc
from solvetrail.sources.tables import Counters

MANIFEST = (
    "backup_timestamp timestamp, problems_count bigint, checksum string, "
    "sync_stats struct<total_problems:bigint, new_problems:bigint, updated_problems:bigint, errors:bigint>"
)


def write_backup(records: DataFrame, path: str, counters: Counters, backup_ts: dt.datetime) -> int:
    """Write the rows, count and sum up what was written, then the manifest. Returns the count."""
    spark = records.sparkSession
    records.write.json(f"{path}/problems")
    count, checksum = _sums(_rows(spark, path))
    stats = (
        counters.total_problems,
        counters.new_problems,
        counters.updated_problems,
        counters.errors,
    )
    manifest = spark.createDataFrame([(utc(backup_ts), count, checksum, stats)], MANIFEST)
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return count


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    """The records of a complete backup; an empty or a damaged one is an error."""
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    if manifest is None:
        raise ValueError(f"no manifest in {path}")
    rows = _rows(spark, path)
    found, checksum = _sums(rows)
    if found != manifest["problems_count"]:
        raise ValueError(f"{path} has {found} rows, its manifest says {manifest['problems_count']}")
    if checksum != manifest["checksum"]:
        raise ValueError(f"rows below {path} are not the ones its manifest was written for")
    if not found:
        raise ValueError(f"no problems in {path}")
    return rows


def _sums(rows: DataFrame) -> tuple[int, str]:
    """How many rows, and the sum of their hashes, which no order of rows or files changes.

    Counted on parsed columns: a line that is not JSON reads as a row without user.
    """
    value = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    found = rows.agg(F.count("user_id").alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("string").alias("sum")).first()
    return found["n"], found["sum"]


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RECORDS).json(f"{path}/problems")
