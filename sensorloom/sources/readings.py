"""Scans of readings and weather, and the predicates that were database queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sensorloom.functions.values import PLAIN_NUMBER_TEXT, SIGNED_PLAIN_NUMBER_TEXT
from sensorloom.schemas import ENERGY_UNITS, READING_SCHEMA, WEATHER_SCHEMA

# The date format of a day file, the weather group, the fill for missing tags.
DAY = re.compile(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
DAY_IN_PATH = r"([0-9]{4}-[0-9]{2}-[0-9]{2})[^0-9]"
WEATHER_GROUP = "weatherRef"
MISSING_TEXT = "empty"


def check_day(day: str) -> str:
    if not DAY.search(day):
        raise ValueError(f"date must start as YYYY-MM-DD: {day!r}")
    return day


def _day_files(spark: SparkSession, folder: str, schema, start: str | None, end: str | None) -> DataFrame:
    """All day files of a folder in one scan; the day filter prunes files before they are read."""
    day = F.regexp_extract(F.concat(F.col("_metadata.file_path"), F.lit(" ")), DAY_IN_PATH, 1)
    # Times are read as text: exports carry a UTC offset that a plain timestamp format rejects.
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    df = (
        spark.read.schema(as_text)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .csv(folder)
        .withColumn("day", day)
        .filter(F.col("day") != "")
        .withColumn("datetime", F.col("datetime").try_cast("timestamp_ntz"))
    )
    if start is not None:
        df = df.filter(F.col("day") >= check_day(start)[:10])
    if end is not None:
        df = df.filter(F.col("day") <= check_day(end)[:10])
    return df


def scan_readings_by_day(
    spark: SparkSession, folder: str, start: str | None = None, end: str | None = None, schema=READING_SCHEMA
) -> DataFrame:
    """Readings of ``YYYY-MM-DD.csv`` files; days without a file just have no rows."""
    return _day_files(spark, folder, schema, start, end)


def scan_weather_by_day(
    spark: SparkSession, folder: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    return _day_files(spark, folder, WEATHER_SCHEMA, start, end)


def union_weather(readings: DataFrame, weather: DataFrame) -> DataFrame:
    """Readings and weather in one frame, missing texts filled so that no group key is null."""
    both = readings.unionByName(weather, allowMissingColumns=True)
    texts = [f.name for f in both.schema.fields if f.dataType.simpleString() == "string"]
    return both.na.fill(MISSING_TEXT, texts)


def dates_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """The days a folder has files for, from file names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    day = F.regexp_extract(F.concat(F.col("path"), F.lit(" ")), DAY_IN_PATH, 1)
    return files.select(day.alias("day")).filter("day <> ''").distinct()


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day from start to end."""
    first, last = (F.lit(check_day(d)[:10]).cast("date") for d in (start, end))
    days = spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("day"))
    return days.select(F.col("day").cast("string").alias("day"))


def date_spine_of(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """One row per day between the first and the last reading, empty days included."""
    span = df.agg(F.to_date(F.min(ts)).alias("lo"), F.to_date(F.max(ts)).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    return days.select(F.col("day").cast("string").alias("day"))


def is_energy_meter() -> Column:
    """Energy consumption readings: unit, a word in the point name or a word in the type."""
    return F.coalesce(
        F.coalesce(F.col("unit").isin(*ENERGY_UNITS), F.lit(False))
        | F.coalesce(F.col("navName").rlike(r"\bEnergy\b"), F.lit(False))
        | F.coalesce(F.col("typeRef").rlike(r"\bkWh\b"), F.lit(False)),
        F.lit(False),
    )


def _site_and_range(df: DataFrame, site: str | None, start: str | None, end: str | None) -> DataFrame:
    """Site and open time interval: from midnight of the first day to 23:59:59 of the last."""
    if site is not None:
        df = df.filter(F.col("siteRef") == site)
    if start is not None:
        df = df.filter(F.col("datetime") > F.lit(f"{check_day(start)[:10]} 00:00:00").cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("datetime") < F.lit(f"{check_day(end)[:10]} 23:59:59").cast("timestamp_ntz"))
    return df


def scan_ec(df: DataFrame, site: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Energy meters of a site and range of days."""
    return _site_and_range(df, site, start, end).filter(is_energy_meter())


def scan_nc(df: DataFrame, site: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """All other sensors of a site and range of days, weather included."""
    weather = F.coalesce(F.col("groupRef") == WEATHER_GROUP, F.lit(False))
    return _site_and_range(df, site, start, end).filter(~is_energy_meter() | weather)


def scan_numeric_range(
    df: DataFrame, site: str | None = None, start: str | None = None, end: str | None = None, signed: bool = False
) -> DataFrame:
    """The dashboard scan: half-open time range, plain numbers only. Timestamps are texts."""
    if site is not None:
        df = df.filter(F.col("siteRef") == site)
    if start is not None:
        df = df.filter(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("datetime") < F.lit(end).cast("timestamp_ntz"))
    return df.filter(F.col("value").rlike(SIGNED_PLAIN_NUMBER_TEXT if signed else PLAIN_NUMBER_TEXT))


def site_list(df: DataFrame, since: str | None = None) -> DataFrame:
    """Distinct sites with data since a time, sorted (the dashboard's dropdown)."""
    if since is not None:
        df = df.filter(F.col("datetime") >= F.lit(since).cast("timestamp_ntz"))
    return df.select("siteRef").distinct().orderBy("siteRef")


def write_readings_by_day(df: DataFrame, path: str, fmt: str = "parquet", ts: str = "datetime") -> None:
    """Readings as one folder per day, so that a range of days prunes to its folders."""
    (
        df.withColumn("date", F.to_date(ts).cast("string"))
        .write.partitionBy("date")
        .format(fmt)
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .save(path)
    )


def read_stored_days(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Readings that ``write_readings_by_day`` stored; folders of other days are not listed or read.

    ``start`` and ``end`` are days or times; the range within a day is left to the scan predicates.
    """
    df = spark.read.format(fmt).load(path).withColumn("date", F.col("date").cast("string"))
    if start is not None:
        df = df.filter(F.col("date") >= check_day(start)[:10])
    if end is not None:
        df = df.filter(F.col("date") <= check_day(end)[:10])
    return df
