"""Linear SVMs of many classes and folds by Newton steps over Spark sums.

The primal of the squared hinge loss needs, for each model, three sums over the rows: loss, gradient
and Hessian. One pass adds up those of all models at once, per task in numpy and then in a tree of
tasks, so what reaches the driver is a few square matrices in the number of columns, however many
rows there are. The driver solves for the steps.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Tasks whose sums are added in one task of the next layer.
FAN_IN = 32
ROUNDS = 200
TOLERANCE = 1e-8
#: Rows of a task that are multiplied at a time.
CHUNK_ROWS = 20_000

_SUMS = "key string, sums array<double>"


@dataclass
class Fit:
    """One against the rest for every class, on some columns and all rows but those of one fold."""

    kept: list[int]
    classes: int
    without_fold: int | None = None
    weights: np.ndarray = None
    loss: np.ndarray = None
    step: np.ndarray = None
    size: np.ndarray = None
    moving: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.weights is None:
            self.weights = np.zeros((self.classes, len(self.kept) + 1))
        self.loss = np.full(self.classes, np.inf)
        self.step = np.zeros_like(self.weights)
        self.size = np.ones(self.classes)
        self.moving = np.ones(self.classes, bool)

    def asked(self) -> np.ndarray:
        """Where the next pass looks: the point after each class's step."""
        return self.weights - self.size[:, None] * self.step

    def take(self, sums: np.ndarray, c: float) -> None:
        """Accept the steps that lower the loss and find the next ones; halve the others."""
        d = self.weights.shape[1]
        at = self.asked()
        for k in np.flatnonzero(self.moving):
            mine = sums[k]
            loss = 0.5 * at[k] @ at[k] + c * mine[0]
            if loss > self.loss[k] and self.size[k] > 1e-6:
                self.size[k] /= 2
                continue
            self.weights[k], self.loss[k] = at[k], loss
            gradient = at[k] + c * mine[2 : 2 + d]
            if np.abs(gradient).max() < TOLERANCE * max(1.0, mine[1]):
                self.moving[k], self.step[k] = False, 0
                continue
            self.step[k] = np.linalg.solve(np.eye(d) + c * mine[2 + d :].reshape(d, d), gradient)
            self.size[k] = 1.0

    def without(self, column: int) -> Fit:
        """The same on one column less, from the weights found."""
        at = [i for i in range(len(self.kept)) if i != column]
        return Fit([self.kept[i] for i in at], self.classes, self.without_fold, self.weights[:, [*at, -1]].copy())


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: sums with the same key added up."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for key, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.asarray(sums.values)
            found[key] = found[key] + values if key in found else values.copy()
    if found:
        yield _batch(found)


def _batch(found: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found)), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], ["key", "sums"]
    )


def tree_sums(parts: DataFrame) -> dict[str, np.ndarray]:
    """Totals of ``key, sums`` rows: layers of tasks add up until one layer of ``FAN_IN`` is left for the driver."""
    n = parts.rdd.getNumPartitions()
    while n > FAN_IN:
        n = math.ceil(n / FAN_IN)
        parts = parts.repartition(n).mapInArrow(_add, _SUMS)
    total: dict[str, np.ndarray] = {}
    for r in parts.collect():
        values = np.array(r["sums"])
        total[r["key"]] = total[r["key"]] + values if r["key"] in total else values
    return total


def _task(payload: bytes):
    """Task over ``label, fold, n, x``: sums of every fit at its point, and hits of the models to be scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, scored = pickle.loads(payload)
        found: dict[str, np.ndarray] = {}

        def add(key: str, values: np.ndarray) -> None:
            found[key] = found[key] + values if key in found else values

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                some = batch.slice(at, CHUNK_ROWS)
                label, fold, n = (some.column(c).to_numpy() for c in ("label", "fold", "n"))
                x = np.asarray(some.column("x").flatten()).reshape(some.num_rows, -1)
                for i, (kept, without, weights, moving) in enumerate(fits):
                    rows = slice(None) if without is None else fold != without
                    a = np.concatenate([x[rows][:, kept], np.ones((len(label[rows]), 1))], axis=1)
                    weight = n[rows].astype(float)
                    for k in np.flatnonzero(moving):
                        y = np.where(label[rows] == k, 1.0, -1.0)
                        gap = np.maximum(0, 1 - y * (a @ weights[k]))
                        active = 2 * weight * (gap > 0)
                        gradient = -2 * a.T @ (weight * y * gap)
                        hessian = (a * active[:, None]).T @ a
                        add(f"{i}:{k}", np.concatenate([[(weight * gap**2).sum(), weight.sum()], gradient, hessian.ravel()]))
                for i, (kept, on, weights) in enumerate(scored):
                    rows = fold == on
                    guess = (x[rows][:, kept] @ weights[:, :-1].T + weights[:, -1]).argmax(axis=1)
                    add(f"hits:{i}", np.array([n[rows][guess == label[rows]].sum(), n[rows].sum()], float))
        if found:
            yield _batch(found)

    return run


def fit_all(data: DataFrame, fits: Sequence[Fit], scored: Sequence[tuple[list[int], int, np.ndarray]] = (), c: float = 1.0) -> list[float]:
    """Fit every ``Fit`` in lockstep on ``label, fold, n, x``; returns the share of hits of ``scored``.

    ``scored`` holds models found before, as columns, fold and weights; they ride on the first pass.
    Raises where a model has not converged after ``ROUNDS`` passes.
    """
    shares: list[float] = []
    for _ in range(ROUNDS):
        live = [f for f in fits if f.moving.any()]
        if not live and not scored:
            return shares
        payload = pickle.dumps(([(f.kept, f.without_fold, f.asked(), f.moving) for f in live], list(scored)))
        total = tree_sums(data.mapInArrow(_task(payload), _SUMS))
        for i in range(len(scored)):
            hit, rows = total.get(f"hits:{i}", (0.0, 0.0))
            shares.append(float(hit / max(1.0, rows)))
        scored = ()
        for i, f in enumerate(live):
            d = f.weights.shape[1]
            f.take([total.get(f"{i}:{k}", np.zeros(2 + d + d * d)) for k in range(f.classes)], c)
    if any(f.moving.any() for f in fits):
        raise RuntimeError(f"no convergence in {ROUNDS} passes")
    return shares
