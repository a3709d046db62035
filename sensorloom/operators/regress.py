"""One ridge regression per energy meter on hourly features."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sensorloom.scratch import spread

# The penalties to choose from.
ALPHAS = [1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8]

# Errors that differ by less than this share differ by rounding only; the smallest penalty wins.
LOO_TIE = 1e-7

# A row that the fit follows more closely than this has no leave-one-out error in doubles.
LEAST_FREE = 1e-6

# The hours' features go to every task as one matrix up to this size, and through a join beyond it.
MATRIX_BYTES = 64 << 20

MODEL_SCHEMA = "uniqueId string, alpha double, intercept double, coefficients array<double>, mse double, hours long"


def join_ec_nc(ec_hours: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Meter hours with the features of the same hour as one array; one join for all meters.

    Neither side is marked for broadcast: the features have one row per hour of the range,
    and Spark decides by their size.
    """
    return meter_hours(ec_hours).join(hour_features(features, columns), ["date", "hour"]).select("uniqueId", "date", "hour", "y", "x")


def meter_hours(ec_hours: DataFrame) -> DataFrame:
    """``uniqueId, date, hour, y``: the target of a meter's model."""
    return ec_hours.select("uniqueId", "date", "hour", F.coalesce(F.col("EC_mean_value"), F.lit(0.0)).alias("y"))


def hour_features(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``date, hour, x``: one row per hour of the range, however many meters there are."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return features.select("date", "hour", x.alias("x"))


def choose_alpha(x: np.ndarray, y: np.ndarray, alphas: Sequence[float] = ALPHAS) -> float:
    """The penalty with the least squared leave-one-out error.

    One decomposition of the centred features serves all penalties: with hat values h, the
    error without row i is e / (1 - h). Where the fit goes through a row whatever its value
    (h = 1, as with a single hour, or hardly any penalty and no more hours than features), that
    error is unknown and the penalty is not chosen; if it is unknown for all, the smallest is.
    """
    n = len(y)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    u, s, _ = np.linalg.svd(xc, full_matrices=False)
    uy = u.T @ yc
    errors = []
    for a in alphas:
        shrink = s**2 / (s**2 + a)
        residual = yc - u @ (shrink * uy)
        free = 1.0 - (1.0 / n + (u**2) @ shrink)
        errors.append(float(np.mean((residual / free) ** 2)) if (free > LEAST_FREE).all() else math.inf)
    best = min(errors)
    return next(a for a, e in zip(alphas, errors) if e <= best * (1 + LOO_TIE) + 1e-15)


def normalised_ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge on centred columns of length 1; coefficients on the scale of ``x``, and intercept."""
    centre = x.mean(axis=0)
    xc = x - centre
    length = np.sqrt((xc**2).sum(axis=0))
    length[length == 0] = 1.0
    z = xc / length
    coef = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / length
    return coef, float(y.mean() - centre @ coef)


def _model(meter: str, x: np.ndarray, y: np.ndarray, alpha: float | None, alphas: Sequence[float]) -> pd.DataFrame:
    a = choose_alpha(x, y, alphas) if alpha is None else alpha
    coef, intercept = normalised_ridge(x, y, a)
    mse = float(np.mean((y - (x @ coef + intercept)) ** 2))
    row = {"uniqueId": meter, "alpha": float(a), "intercept": intercept, "coefficients": coef, "mse": mse, "hours": len(y)}
    return pd.DataFrame([row])


def ridge_fit(
    meters: DataFrame, hours: DataFrame, alpha: float | None = None, alphas: Sequence[float] = ALPHAS, matrix_bytes: int = MATRIX_BYTES
) -> DataFrame:
    """A model per meter of ``meters`` (``uniqueId, date, hour, y``) on ``hours`` (``date, hour, x``).

    Without ``alpha`` each meter chooses its own. Only a meter's hours and targets are shuffled;
    the features, one row per hour, are one matrix that every task reads. Its size is checked,
    and beyond ``matrix_bytes`` the features are joined to the meter hours instead. A group is
    bounded by the hours of the range, not by the number of readings. Hours without features
    are left out.
    """
    alphas = list(alphas)
    spark = meters.sparkSession
    rows, width = hours.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if rows * (width * 8 + 64) > matrix_bytes:
        joined = meters.join(hours, ["date", "hour"])

        def fit_joined(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            # A fixed order of hours, so that the same hours give the same sums.
            pdf = pdf.sort_values(["date", "hour"])
            return _model(key[0], np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(dtype=float), alpha, alphas)

        return spread(joined, "uniqueId").groupBy("uniqueId").applyInPandas(fit_joined, MODEL_SCHEMA)
    kept = hours.orderBy("date", "hour").collect()  # at most matrix_bytes
    matrix = np.array([r["x"] for r in kept], dtype=float).reshape(len(kept), width)
    shared = spark.sparkContext.broadcast(({(r["date"], r["hour"]): i for i, r in enumerate(kept)}, matrix))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        place, features = shared.value
        at = np.array([place.get(k, -1) for k in zip(pdf["date"], pdf["hour"])])
        y = pdf["y"].to_numpy(dtype=float)[at >= 0]
        at = at[at >= 0]
        if not len(at):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("uniqueId", "alpha", "intercept", "coefficients", "mse", "hours")})
        order = np.argsort(at, kind="stable")
        return _model(key[0], features[at[order]], y[order], alpha, alphas)

    return spread(meters, "uniqueId").groupBy("uniqueId").applyInPandas(fit, MODEL_SCHEMA)


def ridge_mse(joined: DataFrame, models: DataFrame) -> DataFrame:
    """In-sample mean squared error per meter from its coefficients."""
    predicted = F.aggregate(F.zip_with("x", "coefficients", lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)
    rows = joined.join(models.select("uniqueId", "intercept", "coefficients"), "uniqueId")
    return rows.groupBy("uniqueId").agg(F.avg((F.col("y") - predicted) * (F.col("y") - predicted)).alias("mse"))


def avg_mse(models: DataFrame) -> DataFrame:
    return models.agg(F.avg("mse").alias("avg_mse"))


def coefficient_features(models: DataFrame) -> DataFrame:
    """Coefficients as rows ``uniqueId, feature, value``."""
    return models.select("uniqueId", F.posexplode("coefficients").alias("feature", "value"))


def join_coefficients(sensors: DataFrame, models: DataFrame) -> DataFrame:
    """Sensor features with the model coefficients, rows of both sides kept."""
    return sensors.join(models.select("uniqueId", "coefficients"), "uniqueId", "full_outer")
