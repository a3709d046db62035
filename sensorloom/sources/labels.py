"""The end-use label table: checked, upserted and written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: labels carry one constant time, so a new write replaces the old label.
LABEL_TIME = "2020-01-01 00:00:00"


def rename_key(labels: DataFrame) -> DataFrame:
    return labels if "uniqueID" in labels.columns else labels.withColumnRenamed("uniqueId", "uniqueID")


def duplicated_ids(labels: DataFrame) -> DataFrame:
    """Ids that occur more than once; an empty result is what a write requires."""
    return rename_key(labels).groupBy("uniqueID").agg(F.count("*").alias("count")).filter("count > 1")


def labels_unique_guard(labels: DataFrame) -> DataFrame:
    """The labels, or an error when an id repeats."""
    if not duplicated_ids(labels).isEmpty():
        raise ValueError("uniqueID repeats in the labels; correct them and run again")
    return rename_key(labels)


def labels_upsert(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Existing labels with those of ``updates`` added or replaced.

    One partial aggregate picks the newest version of an id, so no join and no sort.
    """
    old = rename_key(existing).select("uniqueID", "endUseLabel", F.lit(0).alias("version"))
    new = rename_key(updates).select("uniqueID", "endUseLabel", F.lit(1).alias("version"))
    newest = F.max(F.struct("version", "endUseLabel"))
    return (
        old.unionByName(new)
        .groupBy("uniqueID")
        .agg(newest.alias("n"))
        .select("uniqueID", F.col("n.endUseLabel").alias("endUseLabel"))
        .withColumn("time", F.lit(LABEL_TIME).cast("timestamp_ntz"))
    )


def labels_write(labels: DataFrame, path: str) -> None:
    """Write a checked label table as CSV with a header."""
    labels_unique_guard(labels).select("uniqueID", "endUseLabel").write.option("header", True).csv(path)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Finished versions of a label store, oldest first; a version is finished once its marker is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(hadoop))
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [n for n in names if files.exists(marker(f"{path}/{n}/_SUCCESS"))]


def labels_store(updates: DataFrame, path: str) -> None:
    """Add or replace labels in a store: the updates are checked, merged and written as a new version.

    Readers go on with the version before until the new one is finished.
    """
    checked = labels_unique_guard(updates)
    spark = updates.sparkSession
    versions = _versions(spark, path)
    old = spark.read.parquet(f"{path}/{versions[-1]}") if versions else checked.limit(0)
    number = int(versions[-1].split("-")[0]) + 1 if versions else 0
    labels_upsert(old, checked).write.parquet(f"{path}/{number:08d}-{uuid.uuid4().hex[:8]}")


def stored_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_versions(spark, path)[-1]}")
