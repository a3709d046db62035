"""Boosted stumps from weighted histograms.

Training rows are stored once as bins of each feature. A round is one pass: a task works the
rows' weights out from the stumps so far, counts weight per feature, bin and class, and adds
its counts up; the counts of all tasks meet in two steps. The driver sees one histogram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from sensorloom.scratch import cut_lineage

BINS = 32
GROUPS = 32


def cut_points(rows: DataFrame) -> np.ndarray:
    """``BINS - 1`` quantiles of each feature of ``x``."""
    at = [i / BINS for i in range(1, BINS)]
    long = rows.select(F.posexplode("x").alias("f", "v"))
    found = long.groupBy("f").agg(F.percentile_approx("v", at, 10_000).alias("q")).orderBy("f").collect()  # one row per feature
    return np.array([r["q"] for r in found], dtype=float)


def binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bins of points x features: how many cut points lie below a value."""
    return np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(len(cuts))], axis=1).astype(np.uint8)


def _votes(bins: np.ndarray, stumps: list[tuple], classes: int) -> np.ndarray:
    out = np.zeros((len(bins), classes))
    rows = np.arange(len(bins))
    for f, t, left, right, alpha in stumps:
        out[rows, np.where(bins[:, f] <= t, left, right)] += alpha
    return out


def _histogram(rows: DataFrame, stumps: list[tuple], d: int, classes: int, offset: float) -> np.ndarray:
    """Weight per feature, bin and class; a row's weight is exp of the votes it was denied."""
    shape = (d, BINS, classes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out = np.zeros(shape)
        for batch in batches:
            bins = np.frombuffer(b"".join(batch["bins"]), np.uint8).reshape(len(batch), d)
            y = batch["label"].to_numpy().astype(np.int64)
            votes = _votes(bins, stumps, classes)
            weight = np.exp(votes.sum(axis=1) - votes[np.arange(len(y)), y] - offset)
            for f in range(d):
                out[f] += np.bincount(bins[:, f].astype(np.int64) * classes + y, weight, BINS * classes).reshape(BINS, classes)
        yield pd.DataFrame({"g": [TaskContext.get().partitionId() % GROUPS], "h": [out.tobytes()]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(h, float) for h in parts["h"])
        return pd.DataFrame({"h": [total.tobytes()]})

    sums = rows.mapInPandas(count, "g int, h binary").groupBy("g").applyInPandas(add, "h binary").collect()
    return sum(np.frombuffer(r["h"], float) for r in sums).reshape(shape)


def best_stump(histogram: np.ndarray) -> tuple[int, int, int, int, float]:
    """Feature, last bin of the left side, both sides' classes and the error share, by the least Gini impurity."""
    left = histogram.cumsum(axis=1)[:, :-1]
    whole = histogram.sum(axis=1, keepdims=True)
    right = whole - left
    n_left, n_right = left.sum(axis=2), right.sum(axis=2)
    gini = n_left - (left**2).sum(axis=2) / np.maximum(n_left, 1e-300) + n_right - (right**2).sum(axis=2) / np.maximum(n_right, 1e-300)
    f, t = np.unravel_index(int(np.argmin(np.round(gini / whole[0].sum(), 12))), gini.shape)
    hit = left[f, t].max() + right[f, t].max()
    return int(f), int(t), int(left[f, t].argmax()), int(right[f, t].argmax()), float(1 - hit / whole[f].sum())


def adaboost(train: DataFrame, test: DataFrame, rounds: int = 100) -> DataFrame:
    """Stumps with reweighted rows (SAMME, Zhu et al. 2009): ``id, label, prediction, p_true``."""
    rows = cut_lineage(train.select("label", vector_to_array("features").alias("x")), "boost")
    cuts = cut_points(rows)
    d, classes = len(cuts), int(rows.agg(F.max("label")).first()[0]) + 1

    def to_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                bins = binned(np.stack(batch["x"].to_numpy()).astype(float), cuts)
                yield pd.DataFrame({"label": batch["label"], "bins": [b.tobytes() for b in bins]})

    stored = cut_lineage(rows.mapInPandas(to_bins, "label double, bins binary"), "bins")
    stumps: list[tuple] = []
    offset = 0.0
    for _ in range(rounds):
        histogram = _histogram(stored, stumps, d, classes, offset)
        offset += math.log(histogram[0].sum())
        f, t, left, right, error = best_stump(histogram)
        if error >= 1 - 1 / classes:
            break
        stumps.append((f, t, left, right, math.log((1 - error) / max(error, 1e-12)) + math.log(max(classes - 1, 1))))
        if error <= 1e-12:
            break

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                votes = _votes(binned(np.stack(batch["x"].to_numpy()).astype(float), cuts), stumps, classes)
                share = np.exp((votes - votes.max(axis=1, keepdims=True)) / max(classes - 1, 1))
                share /= share.sum(axis=1, keepdims=True)
                y = batch["label"].fillna(-1).to_numpy().astype(np.int64)
                known = (y >= 0) & (y < classes)
                p = np.where(known, share[np.arange(len(y)), np.clip(y, 0, classes - 1)], np.nan)
                out = pd.DataFrame({"id": batch["id"], "label": batch["label"], "prediction": votes.argmax(axis=1).astype(float)})
                yield out.assign(p_true=[None if np.isnan(v) else v for v in p])

    return test.select("id", "label", vector_to_array("features").alias("x")).mapInPandas(
        predict, "id string, label double, prediction double, p_true double"
    )
