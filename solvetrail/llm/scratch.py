"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A fresh folder for one run's intermediate tables.

    It lies below spark.checkpoint.dir, or below the warehouse where that is unset; both are shared
    on a cluster, so a written table outlives the executors that wrote it. `drop` deletes a table
    that is no longer read; the folder itself goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.spark = spark
        self.base = f"{base.rstrip('/')}/llm/{purpose}-{uuid.uuid4().hex}"
        folder = self._folder(self.base)
        folder.getFileSystem(self._hadoop()).deleteOnExit(folder)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """The frame's rows, written and to be read from there."""
        path = f"{self.base}/{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            folder = self._folder(f"{self.base}/{name}")
            folder.getFileSystem(self._hadoop()).delete(folder, True)

    def _hadoop(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _folder(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
