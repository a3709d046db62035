"""The ordinal model on known structure, its gradient, held-out labels, and odd rows."""

import math

import numpy as np

from sensorloom.llm import quality as q
from sensorloom.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    true = np.zeros(1 << q.BITS)
    true[:40] = rng.normal(0, 2, 40)
    rows = [np.unique(rng.integers(0, 200, 30)) for _ in range(4000)]
    score = np.array([true[r].sum() for r in rows])
    grades = np.digitize(score + rng.logistic(0, 0.5, len(rows)), [-1.5, 1.0, 3.0])
    model = q.CumulativeLink.fit(rows[:3000], grades[:3000], 4)
    assert list(model.thresholds) == sorted(model.thresholds)
    p = model.probabilities(rows[3000:])
    assert (np.diff(p, axis=1) <= 0).all()
    guess = (p > 0.5).sum(axis=1)
    assert np.mean(guess == grades[3000:]) > 0.75 and np.mean(np.abs(guess - grades[3000:]) <= 1) > 0.99
    assert np.corrcoef(p.sum(axis=1), grades[3000:])[0, 1] > 0.9


def plain_tail(weights, cut, row, k):
    return 1 / (1 + math.exp(cut[k] - sum(weights[f] for f in row)))


def plain_loss(weights, cut, rows, grades):
    """Mean negative log likelihood, one document and one feature at a time."""
    total = 0.0
    for row, grade in zip(rows, grades):
        above = plain_tail(weights, cut, row, grade) if grade < len(cut) else 0.0
        at_least = plain_tail(weights, cut, row, grade - 1) if grade else 1.0
        total -= math.log(at_least - above)
    return total / len(rows)


def test_gradient_at_the_fitted_model(monkeypatch):
    """Numerical slopes of the plain likelihood: none along thresholds, the penalty's along weights."""
    monkeypatch.setattr(q, "BITS", 4)
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 16, 5)) for _ in range(150)]
    true = np.concatenate([[3.0, -3.0, 2.0, -2.0], np.zeros(12)])
    grades = np.digitize([true[r].sum() + rng.logistic() for r in rows], [-1.0, 1.0])
    column, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    l1 = 0.02
    model = q.CumulativeLink._descend(column, row, grades, 3, 20_000, l1)
    weights, cut = model.weights, model.thresholds

    def slope(of, at):
        step = np.zeros(len(of))
        step[at] = 1e-5
        losses = [plain_loss(w, c, rows, grades) for w, c in (((of + step, cut), (of - step, cut)) if of is weights else ((weights, of + step), (weights, of - step)))]
        return (losses[0] - losses[1]) / 2e-5

    assert all(abs(slope(cut, k)) < 1e-3 for k in range(2))
    assert (weights == 0).any() and (weights != 0).sum() >= 3
    for f in range(16):
        g = slope(weights, f)
        assert abs(g + l1 * np.sign(weights[f])) < 1e-3 if weights[f] else abs(g) <= l1 + 1e-3


def test_probabilities_match_a_plain_loop():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=1 << q.BITS)
    rows = q.features(["a plain text, a plain text!", "", None, "LOUD LOUD loud 12 12 ??", "Größe und Weg " * 40])
    model = q.CumulativeLink(weights, np.array([-0.5, 0.75]))
    got = model.probabilities(rows)
    for i, row in enumerate(rows):
        for k in range(2):
            assert math.isclose(got[i, k], plain_tail(weights, model.thresholds, row, k), rel_tol=1e-9)


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = q.grade_documents(docs, labels.filter(~test)).join(q.grades(labels.filter(test)), "doc_id").collect()
    kept = {g: np.mean([r.kept for r in out if r.grade == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.99 and kept[1] < 0.1 and kept[0] < 0.1


def test_query_has_every_document(spark):
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op9_quality"](spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in out)


def test_odd_rows(spark):
    rows = [(1, "good text here", "x"), (1, "good text here", "x"), (2, None, "y"), (3, "", "y"), (None, "bad bad bad", "z"), (4, "word " * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 0, 0), (2, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    assert q.grade_documents(docs, labels).count() == len(rows)
    assert q.grade_documents(docs, labels.limit(0)).count() == len(rows)
    assert q.grade_documents(docs.limit(0), labels).collect() == []
