"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if a count has shown that it has at most so many rows.
BROADCAST_ROWS = 200_000
#: About so many rows are a part of a large table, so that what a task holds does not grow with the table.
PART_ROWS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new local folder, but only for a session on one machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="attestor-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, computed once: written as Parquet and read again, so that nothing depends on the executors that did it."""
    path = f"{shared_dir(df.sparkSession)}/attestor/{uuid.uuid4().hex}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """A small table in as many parts as there are cores, as a file of one row group is one task otherwise; the limit is what a
    scan takes for one task at least. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * (4 << 20) else df


def parted(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of so many rows, dealt out by keys into as many parts as they need; as it is where one for each core is enough. Groupings and
    joins on these keys, or more than these, then stay inside the parts."""
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def counted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored table with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df
