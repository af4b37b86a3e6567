"""Class weights and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """(label, n, weight) with balanced weights ``rows / (classes * n)``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    overall = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("n").alias("k"))).scalar()
    return counts.withColumn("_all", overall).select(
        label, "n", (F.col("_all.rows") / (F.col("_all.k") * F.col("n"))).alias("weight")
    )


def outcome_counts(label: Column, prediction: Column, n: Column | None = None) -> list[Column]:
    """Aggregates tp, fp, fn, tn; ``n`` weighs pre-aggregated rows."""
    one = F.lit(1) if n is None else n

    def cell(actual: int, predicted: int) -> Column:
        hit = (label == actual) & (prediction == predicted)
        return F.coalesce(F.sum(F.when(hit, one)), F.lit(0)).cast("long")

    return [
        cell(1, 1).alias("tp"),
        cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"),
        cell(0, 0).alias("tn"),
    ]


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def classification_metrics(
    scored: DataFrame,
    by: str = "model_name",
    label: str = "target",
    prediction: str = "prediction",
    n: str | None = None,
) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where undefined."""
    weight = F.col(n) if n else None
    cells = scored.groupBy(by).agg(*outcome_counts(F.col(label), F.col(prediction), weight))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        by,
        _share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(tp * 2, tp * 2 + fp + fn).alias("f1"),
        "tp", "fp", "fn", "tn",
    )


def confusion_matrix(
    scored: DataFrame,
    by: str = "model_name",
    label: str = "target",
    prediction: str = "prediction",
    n: str | None = None,
) -> DataFrame:
    """One nested array [[tn, fp], [fn, tp]] per group."""
    weight = F.col(n) if n else None
    cells = scored.groupBy(by).agg(*outcome_counts(F.col(label), F.col(prediction), weight))
    return cells.select(
        by, F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix")
    )
