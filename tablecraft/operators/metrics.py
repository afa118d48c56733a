"""Model metrics as aggregates over a table of labels and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tablecraft.operators.ordering import running_sum
from tablecraft.session import materialize


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``n, mse, rmse, mae, r2`` of one scan; a constant label counts as fully explained."""
    rows = df.select(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).dropna()
    e = F.col("y") - F.col("p")
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"),
        F.when(F.min("y") < F.max("y"), F.regr_syy("y", "y")).alias("sst"))
    r2 = F.coalesce(1 - F.try_divide(F.col("sse"), F.col("sst")), F.lit(1.0))
    return one.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per label, one column per predicted class."""
    counts = confusion_counts(df, label, prediction)
    return counts.groupBy("label").pivot("prediction", list(classes)).agg(F.sum("n")).fillna(0, subset=list(classes))


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``class, support, precision, recall, f1`` from the confusion counts; a class never seen scores 0."""
    c = confusion_counts(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = c.select(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("predicted"), hit.alias("tp"))
    predicted = c.select(F.col("prediction").alias("class"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("tp"))
    per = actual.unionByName(predicted).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    scored = per.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return scored.withColumn("f1", f1).select("class", "support", "tp", "precision", "recall", "f1")


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy with weighted and macro precision, recall and F1."""
    per = class_metrics(df, label, prediction)
    n = F.sum("support")

    def weighted(name):
        return (F.sum(F.col(name) * F.col("support")) / n).alias(f"weighted_{name}")

    return per.agg(
        n.alias("n"), (F.sum("tp") / n).alias("accuracy"), *[weighted(m) for m in ("precision", "recall", "f1")],
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")])


def rank_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """``positives, negatives, auc``: the share of (positive, negative) pairs in which the positive row scores higher, ties half.

    Exact: rows are counted by score, and each score's positives beat the negatives below it. Rows without score are passed over.
    """
    p = F.coalesce(F.col(positive).cast("boolean"), F.lit(False))
    counts = materialize(df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(p).alias("p"), F.count_if(~p).alias("n")))
    ranked = running_sum(counts, ["s"], F.col("n"), "upto")
    won = F.sum((F.col("p") * (F.col("upto") - F.col("n") / 2)).cast("double"))
    return ranked.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), won.alias("won")).select(
        "positives", "negatives", F.try_divide("won", F.col("positives").cast("double") * F.col("negatives")).alias("auc"))


def auc(df: DataFrame, classes: int, label: str = "label", probability: str = "probability") -> float:
    """Area under ROC; one-vs-rest weighted by class size for more than two classes."""
    def one(i: int) -> tuple[float, int]:
        rows = df.select((F.col(label) == i).alias("is"), vector_to_array(probability)[i].alias("score"))
        found = rank_auc(rows, "score", "is").first()
        return found["auc"] or 0.0, found["positives"] or 0

    if classes == 2:
        return one(1)[0]
    parts = [one(i) for i in range(classes)]
    total = sum(n for _, n in parts)
    return sum(a * n for a, n in parts) / max(total, 1)
