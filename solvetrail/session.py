"""Session settings and the shared folder for written tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

# Up to this value Spark cuts every map task's rows down to the limit before the shuffle of a
# row_number filter. A larger per-user limit needs a larger value; `first_n` warns then.
GROUP_LIMIT = 10_000

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": str(GROUP_LIMIT),
}

# What one task reads of files or after a shuffle. The operators sort and group these bytes as rows, of which columnar
# files and shuffles hold 10 to 30 times as many bytes in memory. A session that has less keeps it.
TASK_BYTES = 16 << 20
MOST = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
# Rows in memory against bytes in files, by which Spark judges from files whether a side of a join is small enough
# to be broadcast: it takes them as equal, and then sends millions of rows to every task. A session that has more keeps it.
FACTOR, EXPANSION = "spark.sql.sources.fileCompressionFactor", 10.0


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators count on to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key in MOST:
        if _bytes(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, f"{TASK_BYTES}b")
    if float(spark.conf.get(FACTOR)) < EXPANSION:
        spark.conf.set(FACTOR, str(EXPANSION))
    return spark


def _bytes(size: str) -> int:
    """Bytes of a size as Spark writes it: 134217728b, 16m, 64MB."""
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


def local_session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("solvetrail")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        # Recording the Python call site of every column costs more than building the plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path for one run's tables on storage that driver and executors share.

    It lies below spark.checkpoint.dir, or below the warehouse where that is unset, and is
    deleted when the session's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/solvetrail/{purpose}-{uuid.uuid4().hex}"
    system, folder = _folder(spark, path)
    system.deleteOnExit(folder)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it; one that is not there is fine."""
    system, folder = _folder(spark, path)
    system.delete(folder, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies directly in a folder."""
    system, folder = _folder(spark, path)
    return sorted(status.getPath().getName() for status in system.listStatus(folder)) if system.exists(folder) else []


def _folder(spark: SparkSession, path: str):
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()), folder
