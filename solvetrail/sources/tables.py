"""The result tables: row shapes, and a folder that keeps them in partitions.

Below the folder lie versions. A version has the three tables: Problems by bucket of users and month of
solving, Analytics and Progress by bucket. Jobs that rebuild everything write a new version; jobs that change
a part overwrite that part's partitions. A run that ends adds one row to `runs`, which says which version holds.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from solvetrail import schemas
from solvetrail.functions.dates import month_key, utc
from solvetrail.functions.text import join_list, split_list
from solvetrail.operators.select import with_title
from solvetrail.session import delete_folder, subfolders
from solvetrail.sources.bodies import REJECTED

# Partitions of users; the unit in which Analytics and Progress are rewritten. A table keeps the number
# it was created with.
BUCKETS = 16
LAYOUT = {"problems": ("bucket", "month"), "analytics": ("bucket",), "progress": ("bucket",)}
PLACES = {"bucket": "bucket int", "month": "month string"}

RUNS = (
    "run_id bigint, run_ts timestamp, job string, version string, buckets int, settings string, "
    "source string, batch bigint, total_problems bigint, new_problems bigint, updated_problems bigint, errors bigint"
)
# Moments in the runs' rows keep their microseconds.
_MOMENT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def problem_rows(rows: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """Rows of the Problems table."""
    return rows.select(
        "user_id",
        F.coalesce("title", F.lit("")).alias("name"),
        F.coalesce("difficulty", F.lit("")).alias("difficulty"),
        join_list(F.col("topics")).alias("topics_text"),
        "date_solved",
        F.coalesce("attempts", F.lit(1)).cast("bigint").alias("attempts"),
        F.coalesce("status", F.lit("Solved")).alias("status"),
        F.coalesce("problem_id", F.lit("")).alias("problem_id"),
        F.lit(utc(run_ts)).alias("last_updated"),
    )


def problem_records(table: DataFrame) -> DataFrame:
    """The way back: Problems table rows as problem records."""
    renamed = table.withColumnRenamed("name", "title")
    return with_title(renamed).select(
        "user_id",
        "title",
        "difficulty",
        split_list(F.col("topics_text")).alias("topics"),
        "date_solved",
        F.coalesce("attempts", F.lit(1)).cast("bigint").alias("attempts"),
        "status",
        "problem_id",
        "last_updated",
    )


def progress_rows(progress: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """Rows of the Progress table."""
    return progress.select(
        "user_id",
        "date",
        "daily_count",
        "weekly_count",
        "monthly_count",
        "streak",
        "total_solved",
        F.lit(utc(run_ts)).alias("last_updated"),
    )


def with_headings(table: DataFrame, name: str) -> DataFrame:
    """A result table under the headings people know, dates as text and never NULL."""
    cells = []
    for field, heading in zip(table.drop("user_id").schema.fields, schemas.HEADINGS[name], strict=True):
        cell = F.col(field.name)
        if field.dataType.typeName() in ("date", "timestamp", "string"):
            cell = F.coalesce(cell.cast("string"), F.lit(""))
        cells.append(cell.alias(heading))
    return table.select("user_id", *cells)


@dataclass(frozen=True)
class Counters:
    """What a run did."""

    total_problems: int = 0
    new_problems: int = 0
    updated_problems: int = 0
    errors: int = 0


@dataclass(frozen=True)
class Snapshot:
    """The tables of the version that the latest run left."""

    store: Store
    last: Row
    # Of the stream that was asked for.
    batch: int | None = None

    def placed(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table with the columns it is laid out by; with buckets, those partitions alone."""
        places = ", ".join(PLACES[p] for p in LAYOUT[name])
        reader = self.store.spark.read.schema(f"{schemas.RESULTS[name]}, {places}")
        rows = reader.parquet(self.store.path(self.last["version"], name))
        return rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets))

    def read(self, name: str) -> DataFrame:
        return self.placed(name).drop(*LAYOUT[name])

    def records(self) -> DataFrame:
        return problem_records(self.read("problems"))

    @property
    def counters(self) -> Counters:
        return Counters(*(self.last[field.name] for field in fields(Counters)))


class Store:
    """Problems, Analytics and Progress below one folder. One job writes at a time; any number read."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark = spark
        self.base = base.rstrip("/")
        self.buckets = buckets

    def path(self, version: str, name: str) -> str:
        return f"{self.base}/{version}/{name}"

    def runs(self) -> DataFrame:
        """One row per run that ended. A file that a dead run left without a row counts for nothing."""
        rows = self.spark.read.schema(RUNS).options(**_MOMENT).json(f"{self.base}/runs")
        return rows.filter(F.col("run_id").isNotNull())

    def latest(self, source: str | None = None) -> Snapshot | None:
        """What readers see now, and the last batch that a stream has recorded; None before the first run.

        Any failure to read the runs is an error.
        """
        if "runs" not in subfolders(self.spark, self.base):
            return None
        runs = self.runs()
        last = F.max_by(F.struct(*runs.columns), F.struct("run_id", "run_ts")).alias("last")
        batch = F.max(F.when(F.col("source") == F.lit(source), F.col("batch"))).alias("batch")
        found = runs.agg(last, batch).first()
        return Snapshot(self, found["last"], found["batch"]) if found["last"] else None

    def snapshot(self) -> Snapshot:
        found = self.latest()
        if found is None:
            raise FileNotFoundError(f"no tables below {self.base}; call ensure() first")
        return found

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def records(self) -> DataFrame:
        return self.snapshot().records()

    def rejected(self) -> DataFrame:
        """Bodies and cells that runs could not read (run_ts, job, and REJECTED)."""
        return self.spark.read.schema(f"run_ts timestamp, job string, {REJECTED}").parquet(f"{self.base}/rejected")

    def reject(self, found: DataFrame, job: str, run_ts: dt.datetime) -> int:
        """Add rows (REJECTED) to the side table; how many there were is counted as they are written."""
        seen = Observation()
        rows = found.select(F.lit(utc(run_ts)).alias("run_ts"), F.lit(job).alias("job"), "*")
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(f"{self.base}/rejected")
        return seen.get.get("n", 0)

    def ensure(self, run_ts: dt.datetime, source: str | None = None) -> Snapshot:
        """The tables, created empty unless they are there."""
        found = self.latest(source)
        if found is None:
            empty = {n: self.spark.createDataFrame([], s) for n, s in schemas.RESULTS.items()}
            found = self.replace(None, "create", run_ts, None, empty, Counters())
        return found

    def bucket(self, user: Column, base: Snapshot | None) -> Column:
        return F.pmod(F.xxhash64(user), F.lit(base.last["buckets"] if base else self.buckets)).cast("int")

    def place(self, name: str, rows: DataFrame, base: Snapshot | None) -> DataFrame:
        """Rows of a table with the columns it is laid out by."""
        rows = rows.to(self.spark.createDataFrame([], schemas.RESULTS[name]).schema)
        rows = rows.withColumn("bucket", self.bucket(F.col("user_id"), base))
        return rows.withColumn("month", month_key(F.col("date_solved"))) if "month" in LAYOUT[name] else rows

    def write(self, version: str, name: str, placed: DataFrame) -> None:
        """Put rows in place of the partitions they fall into; all other partitions stay.

        Spark deals the rows out by partition, and splits a partition that is far larger than others.
        """
        rows = placed.hint("rebalance", *LAYOUT[name]).write.partitionBy(*LAYOUT[name])
        rows.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(version, name))

    def overwrite(self, base: Snapshot, name: str, placed: DataFrame, cells: set[tuple]) -> None:
        """Put rows, which were written before, in place of these partitions; one without rows goes."""
        filled = {tuple(r) for r in placed.select(*LAYOUT[name]).distinct().collect()}
        if filled:
            self.write(base.last["version"], name, placed)
        self.drop(base, name, cells - filled)

    def drop(self, base: Snapshot, name: str, cells: set[tuple]) -> None:
        """Delete whole partitions, without reading them."""
        for cell in cells:
            named = zip(LAYOUT[name], cell, strict=True)
            place = "/".join(f"{k}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for k, v in named)
            delete_folder(self.spark, f"{self.path(base.last['version'], name)}/{place}")

    def replace(
        self, base: Snapshot | None, job: str, run_ts: dt.datetime, settings: str | None, frames: dict[str, DataFrame], counters: Counters
    ) -> Snapshot:
        """Write the frames as a new version and make it the one that holds.

        The version before stays for those that still read it; older ones, and those that a dead run left, go.
        """
        version = f"v-{uuid.uuid4().hex}"
        for name, frame in frames.items():
            self.write(version, name, self.place(name, frame, None))
        found = self.record(base, job, run_ts, settings, counters, version=version, buckets=self.buckets)
        kept = {version, base.last["version"] if base else None}
        for name in subfolders(self.spark, self.base):
            if name.startswith("v-") and name not in kept:
                delete_folder(self.spark, f"{self.base}/{name}")
        return found

    def record(self, base: Snapshot | None, job: str, run_ts: dt.datetime, settings: str | None, counters: Counters, **more) -> Snapshot:
        """Add the run that follows `base` to the runs."""
        last = base.last.asDict() if base else {"run_id": 0}
        row = {"version": last.get("version"), "buckets": last.get("buckets"), "source": None, "batch": None} | more
        row |= {"run_id": last["run_id"] + 1, "run_ts": utc(run_ts), "job": job, "settings": settings} | asdict(counters)
        names = [field.split()[0] for field in RUNS.split(", ")]
        rows = self.spark.createDataFrame([tuple(row[name] for name in names)], RUNS)
        rows.coalesce(1).write.mode("append").options(**_MOMENT).json(f"{self.base}/runs")
        return Snapshot(self, Row(**row))

    @contextmanager
    def staging(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """Gives a function that writes intermediate rows and reads them back.

        What was written goes when the block ends, so nothing lazy may leave the block.
        """
        folder = f"{self.base}/stage/{uuid.uuid4().hex}"

        def stage(rows: DataFrame) -> DataFrame:
            path = f"{folder}/{uuid.uuid4().hex}"
            rows.write.parquet(path)
            return self.spark.read.schema(rows.schema).parquet(path)

        try:
            yield stage
        finally:
            delete_folder(self.spark, folder)
