"""Streaming twins of the roll-up and of the daily fold."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sensorloom.functions.values import numeric_value, value_type
from sensorloom.operators.aggregate import append_agg_exact, merge_partials, numeric_partials


def hourly_windows(readings: DataFrame, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """Hourly statistics per key with a watermark; works on streams and tables.

    Rows of any kind move the watermark, only numbers count. They are not filtered before, since a
    filter on values is pushed below the watermark, which would then miss rows without numbers.
    """
    x = F.when(value_type("value") == "num", F.nanvl(numeric_value("value"), F.lit(None).cast("double")))
    rows = readings.withColumn("_t", F.col("datetime").cast("timestamp")).withColumn("_x", x).withWatermark("_t", delay)
    return rows.groupBy(F.window("_t", "1 hour").alias("w"), *keys).agg(
        F.avg("_x").alias("mean"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.count("_x").alias("count")
    ).filter("count > 0").select(F.col("w.start").cast("timestamp_ntz").alias("hour_start"), *keys, "mean", "min", "max", "count")


def close_hours(spark: SparkSession, schema: StructType, clock: str, until: Column | str) -> None:
    """Tell a roll-up with this ``clock`` that time has reached ``until``: a row with nothing but a time.

    ``schema`` is that of the readings. The next run of the query gives out all hours that end
    at least its delay before; readings of these hours that come later are late.
    """
    until = F.lit(until) if isinstance(until, str) else until
    row = [until.cast(f.dataType).alias(f.name) if f.name == "datetime" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*row).write.mode("append").parquet(clock)


def stream_rollup_hourly(
    readings: DataFrame, keys: Sequence[str], out: str, checkpoint: str, delay: str = "10 minutes", clock: str | None = None
) -> StreamingQuery:
    """Append finished hours to a Parquet table; an hour is finished once the watermark passed it.

    The last hours of a source that has ended need a closing call: ``clock`` is a folder of Parquet
    files for ``close_hours`` (its rows are read as a second source, from the first run on).
    Each hour comes out once, with or without a restart between.
    """
    if clock is not None:
        spark = readings.sparkSession
        spark.createDataFrame([], readings.schema).write.mode("append").parquet(clock)
        readings = readings.unionByName(spark.readStream.schema(readings.schema).parquet(clock))
    return (
        hourly_windows(readings, keys, delay)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# Batches that stay on their own before they are merged into one.
COMPACT_AFTER = 16


def _batches(spark: SparkSession, state: str) -> dict[tuple[int, int], str]:
    """Finished partial results by the batch numbers, first and last, that they hold; the widest of nested ones."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(state)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = {}
    for status in files.listStatus(root):
        name = status.getPath().getName()
        span = re.fullmatch(r"batches-(\d+)-(\d+)", name)
        if span and files.exists(jvm.org.apache.hadoop.fs.Path(f"{state}/{name}/_SUCCESS")):
            found[int(span[1]), int(span[2])] = f"{state}/{name}"
    return {k: path for k, path in found.items() if not any(o != k and o[0] <= k[0] and k[1] <= o[1] for o in found)}


def stream_fold(
    readings: DataFrame, keys: Sequence[str], state: str, checkpoint: str, compact_after: int = COMPACT_AFTER
) -> StreamingQuery:
    """Keep running totals per key: each micro-batch writes its partial aggregate.

    A batch owns the folder of its number, so a replay overwrites instead of adding. Once there
    are ``compact_after`` folders, all batches before the current one are merged into one folder
    that names the first and last of them; readers then pass over the folders it covers. Only
    finished folders count, and a batch that may still be replayed is never merged.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        numeric_partials(batch, keys).write.mode("overwrite").parquet(f"{state}/batches-{number}-{number}")
        older = {k: path for k, path in _batches(spark, state).items() if k[1] < number}
        if len(older) >= compact_after:
            merged = merge_partials(spark.read.parquet(*older.values()), keys)
            first, last = min(k[0] for k in older), max(k[1] for k in older)
            merged.write.mode("overwrite").parquet(f"{state}/batches-{first}-{last}")

    return (
        readings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def folded(spark: SparkSession, state: str, keys: Sequence[str]) -> DataFrame:
    """The totals so far: an exact merge of all batches."""
    return append_agg_exact(spark.read.parquet(*_batches(spark, state).values()), keys)
