"""Quality of predictions: tables of counts and the numbers from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HIGHER_IS_BETTER = ["accuracy", "precision", "recall", "f1_score"]


def confusion_counts(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(pred: DataFrame, classes: Sequence, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row per actual class, one column ``pred_{class}`` per predicted class."""
    return confusion_counts(pred, actual, predicted).groupBy("actual").agg(
        *[F.coalesce(F.sum(F.when(F.col("predicted") == c, F.col("n"))), F.lit(0)).alias(f"pred_{c}") for c in classes]
    )


def classification_metrics(pred: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by class size, from the counts."""
    counts = confusion_counts(pred, actual, predicted)
    sides = counts.select(F.col("actual").alias("k"), "n", F.lit(0).alias("p"), (F.col("actual") == F.col("predicted")).cast("int").alias("hit")).union(
        counts.select(F.col("predicted").alias("k"), F.lit(0), F.col("n"), F.lit(0))
    )
    per_class = sides.groupBy("k").agg(
        F.sum("n").alias("support"), F.sum("p").alias("named"), F.sum(F.col("n") * F.col("hit")).alias("tp")
    )
    prec = F.coalesce(F.try_divide("tp", "named"), F.lit(0.0))
    rec = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    w, n = F.col("support"), F.sum("support")
    return per_class.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(prec * w) / n).alias("precision"),
        (F.sum(rec * w) / n).alias("recall"),
        (F.sum(f1 * w) / n).alias("f1_score"),
    )


def log_loss(pred: DataFrame, p_true: str = "p_true", eps: float = 1e-15) -> DataFrame:
    """Mean negative log of the probability given to the true class, clipped.

    A row without a probability (its class was never trained) makes the result null.
    """
    p = F.greatest(F.least(F.col(p_true), F.lit(1 - eps)), F.lit(eps))
    missing = F.max(F.col(p_true).isNull())
    return pred.agg(F.when(~missing, -F.avg(F.log(p))).alias("logloss"))


def best_by_metric(results: DataFrame) -> DataFrame:
    """The best model per metric: highest score, lowest log loss."""
    metrics = [*HIGHER_IS_BETTER, "logloss"]
    picks = [F.max_by("model", F.struct(F.col(m), F.col("model"))).alias(m) for m in HIGHER_IS_BETTER]
    picks.append(F.min_by("model", F.struct("logloss", "model")).alias("logloss"))
    return results.agg(*picks).unpivot([], metrics, "metric", "model")


def top_metric(results: DataFrame) -> DataFrame:
    """How many metrics each model is best in; models that tie all count."""
    best = results.agg(
        F.struct(*[F.max(m).alias(m) for m in HIGHER_IS_BETTER], F.min("logloss").alias("logloss")).alias("b")
    ).scalar()
    wins = sum(
        (F.coalesce((F.col(m) == F.col(f"_b.{m}")).cast("int"), F.lit(0)) for m in [*HIGHER_IS_BETTER, "logloss"]), F.lit(0)
    )
    return results.withColumn("_b", best).withColumn("num_best", wins).drop("_b")
