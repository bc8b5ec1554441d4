"""Classifier metrics. Everything follows from one small table of counts by (label, predicted label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1")


def confusion_matrix(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def accuracy(scored: DataFrame) -> DataFrame:
    hit = (F.col("label") == F.col("predicted_label")).cast("int")
    return scored.agg(F.round(F.avg(hit), 6).alias("accuracy"))


def class_metrics(scored: DataFrame) -> DataFrame:
    """Unrounded precision, recall, F1 and support of every class that occurs as label or prediction."""
    cell = F.explode(
        F.array(
            F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("label") == F.col("predicted_label"), F.col("n")).otherwise(0).alias("tp")),
            F.struct(F.col("predicted_label").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
        )
    )
    by_class = (
        confusion_matrix(scored)
        .select(cell.alias("x"))
        .groupBy(F.col("x.c").alias("label"))
        .agg(F.sum("x.actual").alias("support"), F.sum("x.predicted").alias("_predicted"), F.sum("x.tp").alias("_tp"))
    )
    precision, recall = ratio("_tp", "_predicted"), ratio("_tp", "support")
    return by_class.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", F.coalesce(F.try_divide(2.0 * F.col("_tp"), F.col("support") + F.col("_predicted")), F.lit(0.0))
    )


def ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def macro_average() -> list[Column]:
    return [F.avg(n).alias(n) for n in METRICS]


def weighted_average() -> list[Column]:
    return [F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in METRICS]


def weighted_prf(scored: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    return _rounded(class_metrics(scored).agg(*weighted_average()))


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def classification_report(scored: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support, then macro and weighted averages."""
    classes = class_metrics(scored).select("label", "precision", "recall", "f1", "support")
    report = classes
    for name, columns in (("macro avg", macro_average()), ("weighted avg", weighted_average())):
        report = report.unionByName(classes.agg(*columns, F.sum("support").alias("support")).withColumn("label", F.lit(name)))
    return _rounded(report)


def worst_classes(scored: DataFrame, k: int = 5) -> DataFrame:
    """The classes with the lowest F1; label order breaks ties."""
    return _rounded(class_metrics(scored).select("label", "f1", "support")).orderBy("f1", "label").limit(k)


def misclassified(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("label") != F.col("predicted_label"))


def summary(scored: DataFrame) -> DataFrame:
    """Samples, accuracy and weighted precision, recall and F1 in one row."""
    total = F.sum("support")
    return _rounded(class_metrics(scored).agg(total.alias("samples"), F.try_divide(F.sum("_tp"), total).alias("accuracy"), *weighted_average()))
