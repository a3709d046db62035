"""Quality grades by ordinal cumulative-link regression on hashed words.

A document has one score, the sum of its features' weights; ordered thresholds turn the score
into the probability of each grade: P(grade <= k) = logistic(threshold_k - score). All grades
share the weights. Features are the presence of each word and each run of marks, hashed, and a
few shapes (how repetitive, how loud, how full of marks) in steps. Training takes a bounded
sample of labelled rows, ``SAMPLE_ROWS`` by hash of the id, in one task; an L1 penalty leaves
weights for the features that matter, so long texts do not gather noise. Scoring reads every
text once where it is scanned and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorloom.llm.text import Words, byte_classes, mix, pieces

#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 20_000
BITS = 18
ROUNDS = 200
#: Penalty that chooses the features, and the milder one that their weights are fitted with.
L1 = 4e-4
REFIT_L1 = 1e-4
MIN_ROWS = 5
#: A document is kept if it has the highest grade with at least this probability.
KEEP_PROBABILITY = 0.5

_CLASSES = byte_classes(b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", rest=2)
_CLASSES[list(b"\t\n\x0b\x0c\r ")] = 0
_SHAPES = 3
_STEPS = 10


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct feature numbers below ``2**BITS`` of each text; none for a text without words."""
    w = Words(texts, _CLASSES)
    raw = np.frombuffer(w.data, np.uint8)
    numbers = (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    loud = np.concatenate(([0], np.cumsum([_capitals(t) for t in texts])))
    is_mark = _CLASSES[raw] == 2
    marks = np.concatenate(([0], np.cumsum(is_mark)))
    out = []
    for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
        if a == b:
            out.append(np.zeros(0, np.int64))
            continue
        mine = w.hashes[a:b]
        size = w.first[i + 1] - w.first[i] - 1
        again = np.mean(mine[1:] == mine[:-1]) if b - a > 1 else 0.0
        shape = [again, (loud[i + 1] - loud[i]) / size, (marks[w.first[i + 1] - 1] - marks[w.first[i]]) / size]
        step = np.minimum(np.ceil(np.array(shape) * 2 * _STEPS), _STEPS).astype(np.int64)
        # One feature for each step reached, so the weights add up along a shape.
        reached = np.concatenate([np.arange(1, s + 1) + k * (_STEPS + 1) for k, s in enumerate(step)])
        shapes = mix(reached.astype(np.uint64) + np.uint64(7 << 40)) >> np.uint64(64 - BITS)
        out.append(np.unique(np.concatenate([numbers[a:b], shapes.astype(np.int64)])))
    return out


def _capitals(text: str | None) -> int:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return int(np.count_nonzero((raw >= 65) & (raw <= 90)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """Weights over hashed features and ascending thresholds between grades 0, 1, ..."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = ROUNDS) -> CumulativeLink:
        """Minimise the mean negative log likelihood plus ``l1 * |w|``, then again on the chosen features."""
        column = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        used = np.bincount(column, minlength=1 << BITS) >= MIN_ROWS
        for l1 in (L1, REFIT_L1):
            keep = used[column]
            column, row = column[keep], row[keep]
            model = cls._descend(column, row, grades, n_grades, rounds, l1)
            used = model.weights != 0
        return model

    @classmethod
    def _descend(cls, column, row, grades, n_grades: int, rounds: int, l1: float) -> CumulativeLink:
        """Proximal gradient steps with a rate of its own for each feature."""
        n = max(1, len(grades))
        weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
        share = np.cumsum(np.bincount(grades, minlength=n_grades) + 0.5)[:-1] / (n + 0.5 * n_grades)
        cut = np.log(share / (1 - share))  # the best thresholds for weights of 0
        cut_seen = np.full(len(cut), 1e-8)
        for _ in range(rounds if len(grades) else 0):
            score = np.bincount(row, weights[column], len(grades))
            edges = np.concatenate(([-np.inf], cut, [np.inf]))
            high, low = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
            slope = (1 - high - low) / n
            g = np.bincount(column, slope[row], 1 << BITS)
            seen += g * g
            rate = 0.5 / np.sqrt(seen)
            weights = weights - rate * g
            weights = np.sign(weights) * np.maximum(0, np.abs(weights) - rate * l1)
            p = np.maximum(high - low, 1e-12)
            up, down = high * (1 - high) / p / n, low * (1 - low) / p / n
            g = -np.bincount(grades, up, n_grades)[:-1] + np.bincount(grades, down, n_grades)[1:]
            cut_seen += g * g
            cut = np.sort(cut - 0.5 / np.sqrt(cut_seen) * g) + 1e-6 * np.arange(len(cut))
        return cls(weights, cut)

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) for each row and each threshold k."""
        score = np.array([self.weights[r].sum() for r in rows])
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            found = [f.tolist() for f in features(part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "grade", "features"]
            )


def _train(n_grades: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grades = [], []
        for batch in batches:
            grades += batch.column(1).to_pylist()
            rows += [np.array(f, np.int64) for f in batch.column(2).to_pylist()]
        model = CumulativeLink.fit(rows, np.array(grades, np.int64), n_grades, rounds)
        at = np.flatnonzero(model.weights)
        values = [[at.tolist()], [model.weights[at].tolist()], [model.thresholds.tolist()]]
        kinds = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["at", "weights", "thresholds"])

    return run


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> CumulativeLink:
    """Fit on ``rows`` rated documents at most. ``docs``: ``doc_id, text``; ``ratings``: ``doc_id, grade``.

    Ratings with a null id or grade are left out; of several for one id the lowest counts. Rows
    of ``docs`` that repeat an id count once. Without any rated document all weights are 0.
    """
    rated = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")  # at most ``rows`` small rows
    found = chosen.mapInArrow(_featurise, "doc_id long, grade int, features array<int>").dropDuplicates(["doc_id"])
    model = (
        found.repartition(1)
        .sortWithinPartitions("doc_id")
        .mapInArrow(_train(n_grades, rounds), "at array<int>, weights array<double>, thresholds array<double>")
        .first()
    )
    weights = np.zeros(1 << BITS)
    weights[model["at"]] = model["weights"]
    return CumulativeLink(weights, np.array(model["thresholds"]))


def score(docs: DataFrame, model: CumulativeLink, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's expected grade and tail probability of the highest grade; one row per row.

    Null and empty texts have a score of 0, so they get the grades' base rates.
    """
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = CumulativeLink(weights, thresholds)
        for batch in batches:
            for part in pieces(batch, "text"):
                p = fitted.probabilities(features(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, -1].copy())], ["doc_id", "expected_grade", "tail_probability"]
                )

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from labels: 0 toxic, 1 of low quality, 2 good. A row with both columns null has none."""
    toxic, quality = F.coalesce(F.col("toxic"), F.lit(0)), F.coalesce(F.col("quality"), F.lit(1))
    grade = F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)
    known = F.col("toxic").isNotNull() | F.col("quality").isNotNull()
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(known, grade).alias("grade"))


def grade_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP_PROBABILITY, **options) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, kept`` for every row of ``docs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(source, train(source, grades(labels), 3, **options))
    return scored.withColumn("kept", F.col("tail_probability") >= keep)


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP_PROBABILITY, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier keeps; nothing is shuffled."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(source, grades(labels), 3, **options)
    weights, thresholds = model.weights, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = CumulativeLink(weights, thresholds)
        for batch in batches:
            for part in pieces(batch, "text"):
                p = fitted.probabilities(features(part.column("text").to_pylist()))
                yield part.filter(pa.array(p[:, -1] >= keep))

    return docs.mapInArrow(run, docs.schema)
