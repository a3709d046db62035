"""From readings to end-use labels: cluster, regress, join, classify.

The steps of one job. Readings are scanned lazily from the same source; each step that an
iterative algorithm follows is written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from sensorloom.functions import flags, rules
from sensorloom.functions.ids import unique_id
from sensorloom.functions.values import split_datetime
from sensorloom.operators import aggregate as A
from sensorloom.operators import blocks as B
from sensorloom.operators import clusterhours as C
from sensorloom.operators.classify import clf_bagging
from sensorloom.operators.clustering import agglom_single
from sensorloom.operators.encode import min_max_scale
from sensorloom.operators.regress import hour_features, meter_hours, ridge_fit
from sensorloom.schemas import SENSOR_TAGS, STATS, UNKNOWN_CODE
from sensorloom.scratch import cut_lineage
from sensorloom.sources import metadata as M
from sensorloom.sources import readings as R

NUMERIC = [*STATS, "update_rate"]
ONE_HOT = [name for name, _, _ in flags.SELECTED_ONE_HOT]


@dataclass(frozen=True)
class Settings:
    """Production settings."""

    clusters: int = 20
    trees: int = 100
    site: str | None = None
    start: str | None = None
    end: str | None = None


def cluster_phase(readings: DataFrame, s: Settings) -> tuple[DataFrame, list[str]]:
    """Hourly features of sensor clusters: ``hour, date`` and the feature columns."""
    nc = R.scan_nc(split_datetime(readings), s.site, s.start, s.end)
    stats = A.update_rate_nc(A.daily_fold(nc, SENSOR_TAGS), A.days_of(nc).scalar())
    stats = cut_lineage(min_max_scale(cut_lineage(stats, "nc"), NUMERIC).withColumn("id", F.concat_ws("|", *SENSOR_TAGS)), "nc")
    named = agglom_single(B.points_of(stats, F.col("id"), NUMERIC, ["unit"]), s.clusters)
    # At most as many names as clusters were asked for.
    names = [r[0] for r in named.select("cluster").distinct().orderBy("cluster").collect()]
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("cluster")).cast("int") - 1
    assignment = cut_lineage(
        stats.select("id", *SENSOR_TAGS).join(named.select("id", number.alias("cluster")), "id").drop("id"), "assignment"
    )
    ks = list(range(len(names)))
    hours = C.sensor_hours(nc)
    wide = C.cluster_hourly_wide(C.cluster_hourly_long(hours, assignment), ks)
    rates = C.cluster_update_rate(C.cluster_update_counts(hours, assignment), C.sensors_per_cluster(assignment))
    return C.join_update_rates(wide, C.cluster_update_rate_wide(rates, ks)), C.feature_columns(ks)


def regression_phase(readings: DataFrame, features: DataFrame, columns: list[str], s: Settings) -> tuple[DataFrame, DataFrame]:
    """Statistics and ridge coefficients per energy meter."""
    ec = R.scan_ec(split_datetime(readings), s.site, s.start, s.end).withColumn("uniqueId", unique_id(s.site))
    stats = A.update_rate_ec(A.ec_sensor_stats(ec), A.days_of(ec).scalar()).withColumnRenamed("unit", "ec_unit")
    hours = min_max_scale(cut_lineage(A.ec_hourly_mean(ec), "ec_hours"), ["EC_mean_value"])
    scaled = min_max_scale(cut_lineage(features, "features"), columns)
    return stats, cut_lineage(ridge_fit(meter_hours(hours), cut_lineage(hour_features(scaled, columns), "hours")), "ridge")


def classification_frame(
    stats: DataFrame, models: DataFrame, points: DataFrame, training: DataFrame, width: int, s: Settings
) -> DataFrame:
    """One row per meter: ``uniqueId, code, endUseLabel, features``."""
    labelled = training.withColumn("siteRef", F.lit(s.site)) if s.site is not None else training
    labelled = labelled.withColumn("uniqueId", unique_id(s.site))
    if "value" in labelled.columns:
        labelled = rules.correct_units(labelled)
    labels = labelled.select(
        "uniqueId", flags.is_gas_clean().alias("isGas"), "equipRef", "groupRef", "navName", "endUseLabel"
    ).distinct()
    meta = M.point_metadata(points, s.site).withColumnRenamed("unit", "md_unit")
    joined = stats.join(meta, "uniqueId", "left").join(labels, "uniqueId", "left")
    joined = joined.withColumns({"equipRef": rules.equip_label(), "navName": rules.nav_label()})
    scaled = min_max_scale(cut_lineage(flags.one_hot_fixed(joined), "step3"), NUMERIC)
    both = scaled.join(models.select("uniqueId", "coefficients"), "uniqueId", "full_outer")
    x = F.concat(
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*NUMERIC, *ONE_HOT]]),
        F.coalesce("coefficients", F.array_repeat(F.lit(0.0), width)),
    )
    label = flags.label_or_unknown()
    return both.select(
        "uniqueId", flags.label_code("endUseLabel").alias("known"), label.alias("endUseLabel"), array_to_vector(x).alias("features")
    ).select("uniqueId", F.coalesce("known", F.lit(UNKNOWN_CODE)).alias("code"), "endUseLabel", "features")


def predict_unknown(frame: DataFrame, trees: int = 100, model=clf_bagging) -> DataFrame:
    """Labels of all meters: given ones as they are, unknown ones predicted, as texts."""
    rows = frame.select(
        F.col("uniqueId").alias("id"), F.col("code").cast("double").alias("label"), "features", "code", "endUseLabel"
    )
    train, unknown = flags.train_predict_split(rows)
    predicted = model(train, unknown, trees=trees).select("id", F.col("prediction").cast("int").alias("code"))
    # One row per class, also when two spellings share a code.
    names = train.groupBy("code").agg(F.min("endUseLabel").alias("endUseLabel"))
    return train.select("id", "code").unionByName(predicted).join(names, "code").select(F.col("id").alias("uniqueId"), "endUseLabel")


def label_unknown(readings: DataFrame, points: DataFrame, training: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``uniqueId, endUseLabel`` for every energy meter."""
    features, columns = cluster_phase(readings, settings)
    stats, models = regression_phase(readings, features, columns, settings)
    frame = classification_frame(stats, models, points, training, len(columns), settings)
    return predict_unknown(cut_lineage(frame, "step4"), settings.trees)
