"""The folder that the driver and all executors see, and tables cut off from their lineage there."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a local master takes a temporary folder and any other is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="geovelo-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows a task when rows are dealt by key for a chain of windows, each of which holds and sorts a task's rows.
ROWS = 100_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows hashed by keys to a task for each ROWS rows, so that what a task holds doesn't grow with the table. rows is counted: it should be a table as it is read, whose files tell that."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / ROWS))
    return rows.repartition(tasks, *keys)
