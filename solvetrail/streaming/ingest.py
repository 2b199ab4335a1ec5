"""Scheduled ingest: every run takes the submissions that landed since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from solvetrail import schemas
from solvetrail.operators import select
from solvetrail.plans.jobs import Landed, Run, incremental_refresh
from solvetrail.sources import submissions
from solvetrail.sources.bodies import Opened


def _reader(spark: SparkSession, schema: str, files_per_batch: int | None) -> DataStreamReader:
    reader = spark.readStream.schema(schema)
    return reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader


def landed_rows(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Submission rows as they land in Parquet files below a folder."""
    return _reader(spark, schemas.SUBMISSIONS, files_per_batch).parquet(path)


def landed_pages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> Opened:
    """Submissions out of list pages as they land in JSON files below a folder, and the pages that can't be read."""
    return submissions.opened(_reader(spark, submissions.PAGES, files_per_batch).json(path))


def first_seen(landed: DataFrame, items: DataFrame) -> DataFrame:
    """Of a stream of submissions those that solve an item the user has not solved in an earlier batch.

    The state store keeps, per user and item, the first accepted submission of the first batch that had one.
    All rows of a batch bear the batch's time, so a key is new exactly if the time of its first submission
    is that of its latest. Within a batch the first in list order counts. Items without metadata wait: they
    are not solved until a batch that knows them.
    """
    rows = select.with_slug(select.accepted(landed)).withColumn("batch_time", F.current_timestamp())
    known = rows.join(items.select("title_slug").distinct(), "title_slug", "left_semi")
    cells = [c for c in rows.columns if c not in ("user_id", "title_slug", "batch_time", "seq")]
    kept = known.groupBy("user_id", "title_slug").agg(
        F.min(F.struct("batch_time", "seq", *cells)).alias("first"), F.max("batch_time").alias("latest")
    )
    return kept.filter(F.col("first.batch_time") == F.col("latest")).select("user_id", "title_slug", "first.seq", *(f"first.{c}" for c in cells))


def start_ingest(
    run: Run,
    landed: Landed,
    items: DataFrame,
    checkpoint: str,
    limit: int | None = None,
) -> list[StreamingQuery]:
    """Start a run over what is new in the stream `landed`; it ends when that is done.

    Items that earlier batches brought are dropped in the stream, by its state; each batch of the rest is one
    incremental refresh. The refresh records the batch's number, so a batch that is replayed after a failure
    writes nothing. With a limit, or attempts to count, all submissions of a batch are needed, so there the
    refresh alone finds what is new. Pages that can't be read go to the side table, by a stream of their own.

    A batch's own plans are not adaptive: each of their shuffles has the session's number of partitions. So a batch
    is written first, and the refresh starts from what was written, with the items that it names.
    """
    rows = landed.rows if isinstance(landed, Opened) else landed

    def refresh(batch: DataFrame, number: int) -> None:
        with run.store.staging() as stage:
            written = stage(batch)
            slugs = stage(written.select("title_slug").distinct())
            incremental_refresh(run, written, items.join(slugs, "title_slug", "left_semi"), limit, source=checkpoint, batch=number)

    def keep(batch: DataFrame, number: int) -> None:
        run.store.reject(batch, f"stream {number}", run.run_ts)

    started = []
    if limit is None and not run.count_attempts:
        rows, mode = first_seen(rows, items), "update"
    else:
        mode = "append"
    for frame, write, folder in ((rows, refresh, checkpoint), (getattr(landed, "rejected", None), keep, f"{checkpoint}-rejected")):
        if frame is not None:
            sink = frame.writeStream.foreachBatch(write).outputMode(mode if write is refresh else "append")
            started.append(sink.option("checkpointLocation", folder).trigger(availableNow=True).start())
    return started


def ingest(run: Run, landed: Landed, items: DataFrame, checkpoint: str, **options) -> None:
    """Run `start_ingest` to its end; a failed batch raises."""
    for query in start_ingest(run, landed, items, checkpoint, **options):
        query.awaitTermination()
