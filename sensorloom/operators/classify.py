"""Classifiers. Every model takes ``id, label (0..k-1 double), features (vector)`` and gives
``id, label, prediction, p_true`` for the test rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from sensorloom.operators import extra_trees
from sensorloom.operators.bagged_trees import ForestClassifier
from sensorloom.operators.blocks import nearest_k
from sensorloom.operators.boosting import adaboost
from sensorloom.operators.metrics import classification_metrics, log_loss, top_metric
from sensorloom.scratch import cut_lineage

TREES = 100
VAR_SMOOTHING = 1e-9
#: Models of one class against the rest that are fitted at once, and classifiers that are compared at once.
FITS = 8
COMPARED = 5
#: A bound against endless runs only: the solver ends by its tolerance, far below it.
SVM_ROUNDS = 5000


def assemble(df: DataFrame, id_: str, columns: list[str], label: str | None = None) -> DataFrame:
    """Numeric columns as one vector; nulls are 0."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    cols = [F.col(id_).cast("string").alias("id"), array_to_vector(x).alias("features")]
    if label is not None:
        cols.append(F.col(label).cast("double").alias("label"))
    return df.select(*cols)


def _with_p_true(out: DataFrame, probability: str = "probability") -> DataFrame:
    """A class the model never saw has no probability."""
    p = vector_to_array(probability)
    return out.select("id", "label", "prediction", F.get(p, F.col("label").cast("int")).alias("p_true"))


def _ml(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    return _with_p_true(estimator.fit(train).transform(test))


def _of_forest(estimator: ForestClassifier, train: DataFrame, test: DataFrame) -> DataFrame:
    out = estimator.fit(train).transform(test)
    return out.select("id", "label", "prediction", F.get("probability", F.col("label").cast("int")).alias("p_true"))


def _softmax_of_margins(out: DataFrame) -> DataFrame:
    """One-vs-rest margins as probabilities."""
    raw = vector_to_array("rawPrediction")
    out = out.withColumn("_r", raw).withColumn("_m", F.array_max("_r"))
    e = F.transform("_r", lambda v: F.exp(v - F.col("_m")))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    p = F.get(e, F.col("label").cast("int")) / total
    return out.select("id", "label", "prediction", p.alias("p_true"))


def _one_vs_rest(classifier, train: DataFrame, test: DataFrame) -> DataFrame:
    model = OneVsRest(classifier=classifier, parallelism=FITS).fit(train)
    model.setRawPredictionCol("rawPrediction")
    return _softmax_of_margins(model.transform(test))


def clf_bagging(train, test, trees: int = TREES, seed: int = 0):
    """Bagged full trees: every split may use every feature."""
    return _of_forest(ForestClassifier(trees, tries="all", seed=seed), train, test)


def clf_decision_tree(train, test, seed: int = 0):
    return _ml(DecisionTreeClassifier(impurity="entropy", maxDepth=30, seed=seed), train, test)


def clf_random_forest(train, test, trees: int = TREES, seed: int = 0):
    return _of_forest(ForestClassifier(trees, seed=seed), train, test)


def clf_extra_trees(train, test, trees: int = TREES, seed: int = 0):
    """Full trees without bootstrap, with a random threshold for each node and feature tried."""
    return extra_trees.fit(extra_trees.as_rows(train), trees, seed).predict(extra_trees.as_rows(test))


def clf_logistic(train, test):
    """Multinomial logistic regression with the L2 weight of C = 1."""
    n = train.count()
    return _ml(LogisticRegression(family="multinomial", regParam=1.0 / n, maxIter=100), train, test)


def clf_gbt(train, test, rounds: int = TREES, seed: int = 0):
    """Boosted trees, one model per class against the rest."""
    return _one_vs_rest(GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.1, seed=seed), train, test)


def clf_kernel_svm(train, test, components: int = 100, seed: int = 0):
    """Radial-kernel SVM by random Fourier features (Rahimi and Recht 2007) and linear SVMs.

    gamma is 1 / (features x variance), as is usual for scaled data.
    """
    d = int(train.select(F.size(vector_to_array("features"))).first()[0])
    var = train.select(F.explode(vector_to_array("features")).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=math.sqrt(2.0 / (d * var)), size=(components, d))
    b = rng.uniform(0, 2 * math.pi, size=components)

    @F.pandas_udf("array<double>")
    def lifted_features(x: pd.Series) -> pd.Series:
        values = np.stack(x.to_numpy()).astype(float)
        return pd.Series(list(math.sqrt(2.0 / components) * np.cos(values @ w.T + b)))

    def lift(df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(lifted_features(vector_to_array("features"))))

    # Every iteration reads the lifted rows, so they are computed once.
    lifted = cut_lineage(lift(train), "lifted")
    svm = LinearSVC(maxIter=SVM_ROUNDS, regParam=1.0 / max(lifted.count(), 1))
    return _one_vs_rest(svm, lifted, lift(test))


def clf_adaboost(train, test, rounds: int = TREES):
    return adaboost(train, test, rounds)


def clf_gaussian_nb(train: DataFrame, test: DataFrame) -> DataFrame:
    """Gaussian naive Bayes from one aggregate of the training rows.

    The model (classes x features) is one row used as a scalar subquery; a test row is
    scored by array expressions.
    """
    arr = train.select("label", F.posexplode(vector_to_array("features")).alias("f", "v"))
    stats = arr.groupBy("label", "f").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count("*").alias("n"))
    spread = arr.groupBy("f").agg(F.var_pop("v").alias("s")).agg((F.max("s") * VAR_SMOOTHING).alias("e")).scalar()
    per_class = (
        stats.withColumn("s", F.col("s") + spread)
        .groupBy("label")
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("f", "m", "s"))).alias("p"))
    )
    model = per_class.agg(
        F.struct(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("label", "n", "p"))).alias("k")).alias("m")
    ).scalar()
    rows = test.withColumns({"_m": model, "_x": vector_to_array("features")})

    def joint(c):
        ll = F.aggregate(
            F.zip_with(
                F.col("_x"),
                c["p"],
                lambda v, q: F.log(F.lit(2 * math.pi) * q["s"]) + (v - q["m"]) * (v - q["m"]) / q["s"],
            ),
            F.lit(0.0),
            lambda s, t: s + t,
        )
        return F.struct((F.log(c["n"] / F.col("_m.n")) - 0.5 * ll).alias("ll"), (-c["label"]).alias("neg"))

    rows = rows.withColumn("_j", F.transform("_m.k", joint)).withColumn("_best", F.array_max("_j"))
    total = F.aggregate("_j", F.lit(0.0), lambda s, j: s + F.exp(j["ll"] - F.col("_best.ll")))
    mine = F.aggregate(
        F.filter("_j", lambda j: j["neg"] == -F.col("label")), F.lit(None).cast("double"), lambda s, j: F.exp(j["ll"] - F.col("_best.ll"))
    )
    return rows.select("id", "label", (-F.col("_best.neg")).alias("prediction"), (mine / total).alias("p_true"))


def clf_knn(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Exact k nearest neighbours by blocks; votes tie to the smallest label."""

    def points(df: DataFrame, *more: str) -> DataFrame:
        empty = F.array().cast("array<string>")
        return df.select("id", vector_to_array("features").alias("x"), empty.alias("c"), *more)

    near = nearest_k(points(test), points(train, "label"), k, carry=["label"])
    votes = near.groupBy("id", "label").agg(F.count("*").alias("n"))
    per_id = votes.groupBy("id").agg(
        F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("b"),
        F.sum("n").alias("total"),
        F.collect_list(F.struct("label", "n")).alias("v"),
    )
    mine = F.aggregate(F.filter("v", lambda e: e["label"] == F.col("label")), F.lit(0), lambda s, e: s + e["n"].cast("int"))
    return (
        test.select("id", "label")
        .join(per_id, "id")
        .select("id", "label", (-F.col("b.neg")).alias("prediction"), (mine / F.col("total")).alias("p_true"))
    )


CLASSIFIERS = {
    "tree": clf_decision_tree,
    "neighbours": clf_knn,
    "rbf_svm": clf_kernel_svm,
    "logistic": clf_logistic,
    "gaussian_nb": clf_gaussian_nb,
    "forest": clf_random_forest,
    "extra_trees": clf_extra_trees,
    "bagged_trees": clf_bagging,
    "boosted_stumps": clf_adaboost,
    "boosted_trees": clf_gbt,
}

#: They take hundreds of rounds.
SLOW = ("rbf_svm", "boosted_trees", "boosted_stumps")


def _at_once(jobs: Sequence[Callable[[], DataFrame]], most: int) -> list[DataFrame]:
    """What the jobs give, in their order; ``most`` of them run at a time."""
    with ThreadPoolExecutor(most) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def model_comparison(train: DataFrame, test: DataFrame, options: dict[str, dict] | None = None) -> DataFrame:
    """All classifiers with five metrics each, and the number of metrics each wins.

    Most of them are many small jobs one after the other, so several run at a time.
    """
    options = options or {}
    train, test = cut_lineage(train, "train").cache(), cut_lineage(test, "test").cache()
    # Filled before the threads start, which would all fill it.
    train.count(), test.count()

    def fitted(name: str) -> DataFrame:
        return cut_lineage(CLASSIFIERS[name](train, test, **options.get(name, {})), "pred")

    # Those of the most rounds begin first.
    names = sorted(CLASSIFIERS, key=lambda name: name not in SLOW)
    preds = dict(zip(names, _at_once([lambda name=name: fitted(name) for name in names], COMPARED)))
    out = None
    for name in CLASSIFIERS:
        pred = preds[name]
        row = classification_metrics(pred).withColumns({"logloss": log_loss(pred).scalar(), "model": F.lit(name)})
        out = row if out is None else out.unionByName(row)
    result = cut_lineage(out.select("model", "accuracy", "precision", "recall", "f1_score", "logloss"), "results")
    train.unpersist()
    test.unpersist()
    return top_metric(result)
