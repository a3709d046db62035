"""Point metadata of many buildings, whose exports differ in their columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sensorloom.functions.flags import checkmark_flags, checkmark_to_int, unit_omit
from sensorloom.functions.ids import strip_ref, unique_id_metadata
from sensorloom.operators.dedupe import latest_per_key

TOTAL_FIELD = "TOTAL_BUILDINGS"


def scan_metadata_strings(spark: SparkSession, path: str) -> DataFrame:
    """A metadata export with every column as text."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path)


def scan_labels(spark: SparkSession, path: str, site: str) -> DataFrame:
    """Hand labels of one building, with the building name added."""
    return scan_metadata_strings(spark, path).withColumn("siteRef", F.lit(site))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def headers(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The columns of each building's export: ``folder/<building>.csv`` or ``folder/<building>/*.csv``.

    Files are listed without their contents, and of each building one header line is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    inside = F.element_at(F.split("path", re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + "/"), -1)
    building = F.regexp_replace(F.split(inside, "/")[0], r"\.csv$", "")
    # One short row per building.
    rows = files.groupBy(building.alias("building")).agg(F.min("path").alias("path")).orderBy("building").collect()
    return {r["building"]: scan_metadata_strings(spark, r["path"]).columns for r in rows}


def scan_many(spark: SparkSession, folder: str) -> DataFrame:
    """All exports of a folder as text, with the ``building``; a column an export lacks is null there.

    Exports with the same header are one scan; one scan over all would go by the first header.
    """
    kinds: dict[tuple[str, ...], list[str]] = {}
    for building, columns in headers(spark, folder).items():
        kinds.setdefault(tuple(columns), []).append(building)
    frames = []
    for columns, buildings in kinds.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        paths = [f"{folder}/{{{b},{b}.csv}}" for b in buildings]
        scan = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
        name = F.regexp_extract("_metadata.file_path", re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + r"/([^/]+?)(\.csv)?(/|$)", 1)
        frames.append(scan.csv(paths).withColumn("building", name))
    return union_all(frames)


def column_occurrence(spark: SparkSession, headers: dict[str, list[str]]) -> DataFrame:
    """How many buildings have each column in their header, filled or not, and the number of buildings."""
    rows = [(name, c) for name, columns in headers.items() for c in columns]
    rows += [(name, TOTAL_FIELD) for name in headers]
    return (
        spark.createDataFrame(rows, "building string, field string")
        .groupBy("field")
        .agg(F.count("*").alias("count"))
    )


def column_use(points: DataFrame, building: str) -> DataFrame:
    """The same count from one table of all buildings: a building has a column it fills anywhere."""
    fields = [c for c in points.columns if c != building]
    used = points.groupBy(building).agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in fields], F.lit(True).alias(TOTAL_FIELD))
    return (
        used.unpivot([building], [*fields, TOTAL_FIELD], "field", "used")
        .filter("used")
        .groupBy("field")
        .agg(F.count("*").alias("count"))
    )


def common_fields(occurrence: DataFrame, share: float = 0.95, pivot_fields: list[str] | None = None) -> DataFrame:
    """Fields of at least ``int(share * buildings)`` buildings, optionally only those of one building."""
    total = occurrence.filter(F.col("field") == TOTAL_FIELD).select("count").scalar()
    out = occurrence.filter(F.col("field") != TOTAL_FIELD).filter(F.col("count") >= F.floor(F.lit(share) * total))
    return out.filter(F.col("field").isin(*pivot_fields)) if pivot_fields is not None else out


def columns_intersect(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in set(fields)])


def combine_common(buildings: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """All buildings in one table of the common fields, check marks as 1/0 per building."""
    return union_all([checkmark_to_int(columns_intersect(df, fields)) for df in buildings.values()])


def point_metadata(df: DataFrame, site: str | None = None) -> DataFrame:
    """One row per point: id, kind, flags and unit, the last synchronised row winning."""
    keyed = df.withColumn("uniqueId", unique_id_metadata(site)).withColumns(
        {c: strip_ref(c) for c in ("equipRef", "groupRef", "siteRef")}
    )
    latest = latest_per_key(
        keyed.select("uniqueId", "lastSynced", "kind", "energy", "power", "sensor", "unit", "water"),
        ["uniqueId"],
        "lastSynced",
    )
    return (
        checkmark_flags(latest)
        .withColumn("unit", unit_omit())
        .select("uniqueId", "kind", "energy", "power", "sensor", "unit", "water")
    )
