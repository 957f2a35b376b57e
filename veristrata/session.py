"""Session helpers: a local session for tests, and workers that find this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def workers_import(spark: SparkSession) -> None:
    """Lets Python workers of a local session import the package from the checkout.

    On a cluster the package is installed or sent with ``--py-files``; nothing is done there."""
    if spark.sparkContext.master.startswith("local"):
        known = spark.sparkContext.environment.get("PYTHONPATH", "")
        if ROOT not in known.split(os.pathsep) and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``). A local session that names
    none gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veristrata-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/veristrata/{label}-{uuid.uuid4().hex[:12]}"


#: Rows of one key's side that a task of a large join takes, about.
ROWS_A_TASK = 1 << 15


def tasks_for(rows: DataFrame, most: int = ROWS_A_TASK) -> int:
    """Tasks for joins that shuffle ``rows``, one for each ``most`` of them: a fixed number of tasks, or one by compressed
    bytes, lets the memory of each grow with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    folder = scratch_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """The session of the tests and of ``bench.py``."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
