"""Energy use: meter deltas, roll-ups and the sum per end use."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.functions.ids import unique_id_flux
from sensorloom.functions.values import numeric_value
from sensorloom.sources.readings import scan_numeric_range

_LONG_MAX = 2**63 - 1


def meter_readings(df: DataFrame, signed: bool = False, **scan) -> DataFrame:
    """Plain numbers with the dashboard's id, as doubles."""
    return scan_numeric_range(df, signed=signed, **scan).select(
        "siteRef", unique_id_flux().alias("uniqueID"), "datetime", F.col("value").cast("double").alias("value")
    )


def meter_delta(meters: DataFrame, keys: Sequence[str] = ("siteRef", "uniqueID")) -> DataFrame:
    """Highest minus lowest reading per sensor, in one partial aggregate."""
    return meters.groupBy(*keys).agg((F.max("value") - F.min("value")).alias("delta"))


def min_max_table(meters: DataFrame, keys: Sequence[str] = ("siteRef", "uniqueID")) -> DataFrame:
    """Lowest and highest reading per sensor side by side."""
    return meters.groupBy(*keys).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def _micros(df: DataFrame, column: str) -> Column:
    """Microseconds of a time; one without a zone is never put through the session's, which has gaps."""
    at = F.col(column)
    if df.schema[column].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(at.cast("timestamp"))
    minutes = (F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def _time_then_value(micros: Column, value: Column, null_first: bool) -> Column:
    """A fixed-width number that orders like (time, value), a null value before or after all others.

    The bits of a double order like the double once those of negative ones are turned; times of
    the years 1 to 9999 and 64 such bits fit into 38 digits.
    """
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")
    turned = F.when(bits < 0, bits.bitwiseXOR(F.lit(_LONG_MAX))).otherwise(bits)
    none = F.lit(-_LONG_MAX - 1) if null_first else F.lit(_LONG_MAX)
    rank = F.when(value.isNull(), none).otherwise(turned)
    whole = "decimal(20,0)"
    return micros.cast(whole) * F.lit(Decimal(2**64)).cast(whole) + rank.cast(whole)


def meter_delta_first_last(meters: DataFrame, keys: Sequence[str] = ("siteRef", "uniqueID")) -> DataFrame:
    """Last minus first reading per sensor; of readings at one time the greatest is last, the least first.

    Time and value are ordered by one number of fixed width, so a single hash aggregate with a
    map-side phase finds both ends: the readings are read once, and neither sorted nor moved.
    """
    timed = meters.filter("datetime is not null")
    at, value = _micros(timed, "datetime"), F.col("value").cast("double")
    ends = timed.withColumns(
        {"_v": value, "_lo": _time_then_value(at, value, False), "_hi": _time_then_value(at, value, True)}
    )
    return ends.groupBy(*keys).agg((F.max_by("_v", "_hi") - F.min_by("_v", "_lo")).alias("delta"))


def semi_enduse(meters: DataFrame, labels: DataFrame) -> DataFrame:
    """Only readings of labelled sensors."""
    return meters.join(labels.select("uniqueID"), "uniqueID", "left_semi")


def join_enduse(deltas: DataFrame, labels: DataFrame) -> DataFrame:
    """Deltas with their end use; both sides hold one row per sensor."""
    return deltas.join(labels.select("uniqueID", F.col("endUseLabel").alias("end_use_category")), "uniqueID")


def energy_by_end_use(readings: DataFrame, labels: DataFrame, **scan) -> DataFrame:
    """Energy used per site and end use: delta per meter, labelled, summed.

    The readings shrink to one row per meter before anything is joined.
    """
    deltas = meter_delta(meter_readings(readings, **scan))
    return (
        join_enduse(deltas, labels)
        .groupBy("siteRef", "end_use_category")
        .agg(F.sum("delta").alias("energy"), F.count("*").alias("meters"))
    )


def _rollup(df: DataFrame, unit: str, keys: Sequence[str]) -> DataFrame:
    start = F.to_date("datetime").cast("string")
    if unit == "hour":
        parts = {"date": start, "hour": F.hour("datetime")}
    else:
        parts = {"date": start}
    x = F.nanvl(numeric_value("value"), F.lit(None).cast("double"))
    return (
        df.withColumns(parts)
        .withColumn("_x", x)
        .filter("_x is not null")
        .groupBy(*keys, *parts)
        .agg(
            F.avg("_x").alias("mean"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.count("_x").alias("count")
        )
    )


def rollup_hourly(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readings at hourly resolution."""
    return _rollup(df, "hour", keys)


def rollup_daily(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readings at daily resolution."""
    return _rollup(df, "day", keys)


def label_distribution(labels: DataFrame, label: str = "endUseLabel") -> DataFrame:
    """Sensors per label and their share; the total is a scalar of the counted labels."""
    counts = labels.groupBy(label).agg(F.count("*").alias("sensors"))
    total = labels.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("share", F.col("sensors") / total)
