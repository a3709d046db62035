import threading

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sensorloom.operators import classify as C
from sensorloom.operators import metrics as M
from sensorloom.operators import regress as G
from sensorloom.operators import select as S
from sensorloom.operators.newton import FAN_IN, Fit, fit_all
from sensorloom.plans.label_unknown import predict_unknown
from sensorloom.sources import labels as L


def test_alpha_matches_leaving_each_row_out():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(25, 4)), rng.normal(size=25)
    y = y + x[:, 0]

    def loo(a):
        total = 0.0
        for i in range(25):
            keep = np.arange(25) != i
            xm, ym = x[keep].mean(0), y[keep].mean()
            w = np.linalg.solve((x[keep] - xm).T @ (x[keep] - xm) + a * np.eye(4), (x[keep] - xm).T @ (y[keep] - ym))
            total += (y[i] - ym - (x[i] - xm) @ w) ** 2
        return total

    assert G.choose_alpha(x, y) == min(G.ALPHAS, key=loo)


def test_normalised_ridge_solves_its_equations():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=30)
    x[:, 2] = 5.0
    coef, intercept = G.normalised_ridge(x, y, 0.5)
    xc = x - x.mean(0)
    n = np.sqrt((xc**2).sum(0))
    n[n == 0] = 1
    z = xc / n
    assert z.T @ (y - y.mean() - z @ (coef * n)) == pytest.approx(0.5 * coef * n, abs=1e-9)
    assert intercept == pytest.approx((y - x @ coef).mean())
    assert coef[2] == 0


def points(spark, per=40):
    rng = np.random.default_rng(0)
    rows = [(f"{c}-{i}", float(c), Vectors.dense(rng.normal(c * 3, 0.5, size=3))) for c in range(3) for i in range(per)]
    df = spark.createDataFrame(rows, ["id", "label", "features"])
    test = F.substring_index("id", "-", -1).cast("int") % 5 == 0
    return df.filter(~test), df.filter(test)


@pytest.mark.parametrize("name", list(C.CLASSIFIERS))
def test_classifiers_separate_clear_classes(spark, name):
    few = {"forest": {"trees": 10}, "extra_trees": {"trees": 10}, "bagged_trees": {"trees": 10}, "boosted_stumps": {"rounds": 8}, "boosted_trees": {"rounds": 3}}
    pred = C.CLASSIFIERS[name](*points(spark), **few.get(name, {})).collect()
    assert len(pred) == 24
    assert sum(p["prediction"] == p["label"] for p in pred) >= 22
    assert all(0 <= p["p_true"] <= 1 for p in pred)


def test_boosted_stumps_equal_plain_reweighting(spark):
    from sensorloom.operators import boosting as Bo

    train, test = points(spark)
    rows = train.orderBy("id").collect()
    cuts = Bo.cut_points(train.select(C.vector_to_array("features").alias("x")))
    x, y = Bo.binned(np.array([r.features.toArray() for r in rows]), cuts), np.array([int(r.label) for r in rows])
    w, stumps = np.ones(len(y)), []
    for _ in range(6):
        best = None
        for f in range(x.shape[1]):
            for t in range(Bo.BINS - 1):
                sides = [np.bincount(y[m], w[m], 3) for m in (x[:, f] <= t, x[:, f] > t)]
                gini = sum(s.sum() - (s**2).sum() / s.sum() if s.sum() else 0.0 for s in sides) / w.sum()
                if best is None or round(gini, 12) < best[0]:
                    best = (round(gini, 12), f, t, int(sides[0].argmax()), int(sides[1].argmax()))
        _, f, t, left, right = best
        wrong = np.where(x[:, f] <= t, left, right) != y
        error = w[wrong].sum() / w.sum()
        alpha = np.log((1 - error) / error) + np.log(2)
        stumps.append((f, t, left, right, alpha))
        w = w * np.exp(alpha * wrong)
    seen = test.orderBy("id").collect()
    votes = Bo._votes(Bo.binned(np.array([r.features.toArray() for r in seen]), cuts), stumps, 3)
    got = {r["id"]: r["prediction"] for r in Bo.adaboost(train.repartition(5), test, 6).collect()}
    assert got == {r["id"]: float(v.argmax()) for r, v in zip(seen, votes)}


def test_metrics_by_hand(spark):
    pred = spark.createDataFrame([(0.0, 0.0, 0.9), (0.0, 1.0, 0.2), (1.0, 1.0, 0.6), (2.0, 1.0, 0.1)], "label double, prediction double, p_true double")
    m = M.classification_metrics(pred).first()
    assert m["accuracy"] == 0.5
    assert m["precision"] == pytest.approx((2 * 1.0 + 1 / 3) / 4)
    assert m["recall"] == pytest.approx((2 * 0.5 + 1.0) / 4)
    assert m["f1_score"] == pytest.approx((2 * 2 / 3 + 0.5) / 4)
    assert M.log_loss(pred).first()[0] == pytest.approx(-np.mean(np.log([0.9, 0.2, 0.6, 0.1])))
    missing = pred.withColumn("p_true", F.when(F.col("label") < 2, F.col("p_true")))
    assert M.log_loss(missing).first()[0] is None


def test_wins_count_ties(spark):
    rows = [("a", 0.9, 0.8, 0.9, 0.7, 0.3), ("b", 0.9, 0.7, 0.9, 0.8, 0.5)]
    df = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1_score double, logloss double")
    assert {r["model"]: r["num_best"] for r in M.top_metric(df).collect()} == {"a": 4, "b": 3}


def test_elimination_keeps_the_useful_feature(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal(i % 2 * 4)), float(rng.normal()), "xy"[i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, good double, noise double, label string")
    table = S.rfecv(df, ["good", "noise"], "label", "id", S.forest(trees=5)).collect()
    assert {r["num_features"] for r in table} == {1, 2}
    assert next(r for r in table if r["num_features"] == 1)["features"] == ["good"]


def test_elimination_grows_full_trees(spark):
    rng = np.random.default_rng(6)
    rows = [(Vectors.dense(rng.normal(size=3)), float(rng.integers(2))) for _ in range(300)]
    make, _ = S.forest(trees=3)
    model = make().fit(spark.createDataFrame(rows, ["features", "label"]))
    assert min(t.depth for t in model.trees) > 5


def test_known_labels_stay_and_unknown_get_one(spark):
    train, _ = points(spark)
    names = F.element_at(F.array(F.lit("00_A"), F.lit("01_B"), F.lit("02_C")), F.col("label").cast("int") + 1)
    hidden = F.substring_index("id", "-", -1).cast("int") % 7 == 1
    frame = train.select(
        F.col("id").alias("uniqueId"), F.when(hidden, 99).otherwise(F.col("label").cast("int")).alias("code"),
        F.when(hidden, "99_UNKNOWN").otherwise(names).alias("endUseLabel"), "features")
    got = {r["uniqueId"]: r["endUseLabel"] for r in predict_unknown(frame, trees=5).collect()}
    assert got == {r["id"]: ["00_A", "01_B", "02_C"][int(r["label"])] for r in train.collect()}


def test_label_table_guard_and_upsert(spark, tmp_path):
    labels = spark.createDataFrame([("a", "x"), ("b", "y")], "uniqueId string, endUseLabel string")
    with pytest.raises(ValueError):
        L.labels_unique_guard(labels.union(labels))
    new = spark.createDataFrame([("b", "z"), ("c", "w")], "uniqueID string, endUseLabel string")
    got = {r["uniqueID"]: r["endUseLabel"] for r in L.labels_upsert(labels, new).collect()}
    assert got == {"a": "x", "b": "z", "c": "w"}


def test_linear_elimination_keeps_the_useful_categories(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3 == 0), int(i % 3 == 1), int(rng.integers(2)), "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, first int, second int, noise int, label string")
    table = {r["num_features"]: r for r in S.rfecv_linear(df, ["first", "noise", "second"], "label", "id").collect()}
    assert set(table) == {1, 2, 3} and sorted(table[2]["features"]) == ["first", "second"]
    assert table[2]["score"] == 1.0 and table[1]["score"] < 0.8
    assert S.best_count(S.rfecv_linear(df, ["first", "noise", "second"], "label", "id")) == 2


def test_newton_sums_leave_no_gradient_and_spare_a_fold(spark):
    rng = np.random.default_rng(5)
    x, n, fold = rng.normal(size=(90, 3)), rng.integers(1, 4, 90), np.arange(90) % 2
    label = np.digitize(x[:, 0] + 0.5 * rng.normal(size=90), [-0.5, 0.5])
    rows = [(int(k), int(f), int(m), v.tolist()) for k, f, m, v in zip(label, fold, n, x)]
    data = spark.createDataFrame(rows, "label int, fold int, n long, x array<double>").repartition(40)
    fits = [Fit([0, 1, 2], 3), Fit([2, 0], 3, 1)]
    assert data.rdd.getNumPartitions() > FAN_IN and fit_all(data, fits) == []
    for f, use in zip(fits, (fold >= 0, fold != 1)):
        a = np.concatenate([x[use][:, f.kept], np.ones((use.sum(), 1))], axis=1)
        for k in range(3):
            y = np.where(label[use] == k, 1.0, -1.0)
            gap = np.maximum(0, 1 - y * (a @ f.weights[k]))
            assert f.weights[k] - 2 * a.T @ (n[use] * y * gap) == pytest.approx(np.zeros(a.shape[1]), abs=1e-5)
    (share,) = fit_all(data, [], [([2, 0], 1, fits[1].weights)])
    guess = (x[:, [2, 0]] @ fits[1].weights[:, :-1].T + fits[1].weights[:, -1]).argmax(axis=1)
    on = fold == 1
    assert share == pytest.approx((n[on] * (guess[on] == label[on])).sum() / n[on].sum())


def test_linear_elimination_over_200_000_patterns(spark):
    """Nearly every row has a pattern of its own; nothing is capped or gathered."""
    bits = [((F.shiftright("id", k) % 2) == 1).cast("int").alias(f"b{k:02d}") for k in range(18)]
    df = spark.range(1 << 18).filter("id % 5 <> 0").select(F.col("id"), *bits, F.when(F.col("id") % 4 == 3, "yes").otherwise("no").alias("label"))
    table = S.rfecv_linear(df, ["b00", "b01", "b07"] + [f"b{k:02d}" for k in range(8, 18)] + ["b02", "b03", "b04", "b05", "b06"], "label", "id").collect()
    assert df.count() > 200_000 and sorted(next(r for r in table if r.num_features == 2).features) == ["b00", "b01"]
    assert next(r for r in table if r.num_features == 2).score == 1.0


def test_classifiers_are_compared_at_once(spark, monkeypatch):
    met = threading.Barrier(2, timeout=30)

    def guess(value):
        def fit(train, test):
            met.wait()
            return test.select("id", "label", F.lit(value).alias("prediction"), F.lit(0.5).alias("p_true"))

        return fit

    monkeypatch.setattr(C, "CLASSIFIERS", {"ones": guess(1.0), "zeros": guess(0.0)})
    rows = spark.createDataFrame([(str(i), float(i % 4 == 0)) for i in range(8)], "id string, label double")
    got = C.model_comparison(rows, rows).collect()
    assert [(r.model, r.accuracy, r.num_best) for r in got] == [("ones", 0.25, 1), ("zeros", 0.75, 5)]
