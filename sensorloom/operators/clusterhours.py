"""Hourly features of sensor clusters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.operators.aggregate import (
    _fold_hours,
    agg_numeric,
    append_agg_exact,
    combine_mixed,
    pivot_last,
    state_changes,
    with_keys,
)
from sensorloom.functions.values import numeric_value, value_type
from sensorloom.schemas import SENSOR_TAGS, STATS
from sensorloom.scratch import cut_lineage

HOUR_KEYS = ["hour", "date", "cluster"]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which null keys equal each other; Spark plans it as a hash or sort-merge join."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on: Column = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def join_readings_cluster(
    readings: DataFrame, assignment: DataFrame, tags: Sequence[str] = SENSOR_TAGS
) -> DataFrame:
    """Readings with the cluster of their sensor.

    No broadcast hint: the assignment grows with the number of sensors, so Spark broadcasts
    it when its size allows and otherwise splits the hot partitions of the left join.
    """
    return null_safe_join(readings, assignment.select(*tags, "cluster"), tags)


@dataclass(frozen=True)
class SensorHours:
    """Hourly partial results per sensor, written once; what follows never reads readings again.

    ``numbers``: one row per sensor, date and hour with the number of values (``updates``), the
    rows of the number kind, and count, mean, squared deviations, max and min of the numbers.
    ``changes``: state changes of the other kinds, each sensor a sequence of its own.
    """

    numbers: DataFrame
    changes: DataFrame


def sensor_hours(readings: DataFrame, tags: Sequence[str] = SENSOR_TAGS) -> SensorHours:
    """Reduce readings (with ``date`` and ``hour``) to hours of sensors; null tags are tags."""
    is_number = value_type("value") == "num"
    x = F.when(is_number, F.nanvl(numeric_value("value"), F.lit(None).cast("double")))
    numbers = (
        with_keys(readings, ["hour", "date"])
        .withColumns({"_x": x, "_number": is_number})
        .groupBy("hour", "date", *tags)
        .agg(
            F.count("value").alias("updates"),
            F.count(F.when(F.col("_number"), 1)).alias("number_rows"),
            F.count("_x").alias("n"),
            F.coalesce(F.avg("_x"), F.lit(0.0)).alias("mean"),
            F.coalesce(F.var_pop("_x") * F.count("_x"), F.lit(0.0)).alias("m2"),
            F.max("_x").alias("max"),
            F.min("_x").alias("min"),
        )
    )
    changes = state_changes(readings, ["hour", "date", *tags], ["bool", "str"])
    return SensorHours(cut_lineage(numbers, "sensor-hours"), cut_lineage(changes, "sensor-changes"))


def cluster_hourly_long(
    hours: SensorHours, assignment: DataFrame, keys: Sequence[str] = HOUR_KEYS, tags: Sequence[str] = SENSOR_TAGS
) -> DataFrame:
    """Mean, std, max and min per hour, date and cluster, merged exactly from hours of sensors."""
    assigned = assignment.select(*tags, "cluster")
    numbers = with_keys(null_safe_join(hours.numbers.filter("number_rows > 0"), assigned, tags, "inner"), keys)
    merged = append_agg_exact(numbers.select(*keys, "n", "mean", "m2", "max", "min"), keys)
    changes = with_keys(null_safe_join(hours.changes, assigned, tags, "inner"), keys)
    changes = changes.groupBy(*keys, "kind", "change_hour").agg(F.sum("changes").alias("changes"), F.sum("count").alias("count"))
    folded = _fold_hours(changes, [*keys, "kind"], "all").drop("kind")
    return combine_mixed(merged.select(*keys, *STATS, "count").unionByName(folded), keys)


def cluster_hourly_sequence(placed: DataFrame, keys: Sequence[str] = HOUR_KEYS) -> DataFrame:
    """The same with all sensors of a cluster as one time-ordered sequence, which needs the readings."""
    numbers = agg_numeric(placed, keys, "all")
    changes = state_changes(placed, keys, ["bool", "str"])
    return combine_mixed(numbers.unionByName(_fold_hours(changes, [*keys, "kind"], "all").drop("kind")), keys)


def cluster_hourly_wide(long: DataFrame, clusters: Sequence, keys: Sequence[str] = HOUR_KEYS) -> DataFrame:
    """One row per hour and date with columns ``{stat}_{cluster}``."""
    return pivot_last(long, list(keys), clusters).drop("count")


def cluster_update_counts(
    hours: SensorHours, assignment: DataFrame, keys: Sequence[str] = HOUR_KEYS, tags: Sequence[str] = SENSOR_TAGS
) -> DataFrame:
    """Values per hour, date and cluster."""
    joined = null_safe_join(hours.numbers, assignment.select(*tags, "cluster"), tags, "inner")
    return with_keys(joined, keys).groupBy(*keys).agg(F.sum("updates").alias("updates"))


def sensors_per_cluster(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("cluster").agg(F.count("*").alias("sensors"))


def cluster_update_rate(counts: DataFrame, sensors: DataFrame) -> DataFrame:
    """Updates per sensor of a cluster, hour and date."""
    return counts.join(sensors, "cluster").select(
        "hour", "date", "cluster", (F.col("updates") / F.col("sensors")).alias("urate")
    )


def cluster_update_rate_wide(rates: DataFrame, clusters: Sequence) -> DataFrame:
    """One row per hour and date with columns ``urate_{cluster}``."""
    return rates.groupBy("hour", "date").agg(
        *[
            F.coalesce(F.max(F.when(F.col("cluster") == c, F.col("urate"))), F.lit(0.0)).alias(f"urate_{c}")
            for c in clusters
        ]
    )


def join_update_rates(wide: DataFrame, rates_wide: DataFrame) -> DataFrame:
    return wide.join(rates_wide, ["hour", "date"], "left").na.fill(0.0)


def feature_columns(clusters: Sequence) -> list[str]:
    return [f"{s}_{c}" for c in clusters for s in STATS] + [f"urate_{c}" for c in clusters]
