"""Written tables that cut the lineage of iterative jobs.

An iterative job writes its state as Parquet in the shared folder the session names in
``spark.checkpoint.dir`` and reads it back. A lost executor then re-reads files instead of
replaying the rounds, and the scan knows its true size, so Catalyst's own broadcast
threshold decides on facts.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written tables of this application."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if app not in _local_root:
            _local_root[app] = tempfile.mkdtemp(prefix="sensorloom-")
        root = _local_root[app]
    return f"{root.rstrip('/')}/sensorloom/{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage", file_rows: int = 0) -> DataFrame:
    """Write ``df`` once and return a scan of what was written; ``file_rows`` bounds the rows of a file."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition by columns into the session's number of shuffle partitions.

    For costly Python work per group: the grouping needs this shuffle anyway, and a fixed
    number keeps adaptive execution from merging small rows with much work into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)
