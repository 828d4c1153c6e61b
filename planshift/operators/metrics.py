"""Confusion matrix and the metrics read off it, for one frame or per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, classes: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Every (actual, predicted) cell of the class list, zeros included, in one aggregation."""
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("actual"),
                F.lit(p).alias("predicted"),
                F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias("n"),
            )
            for a in classes
            for p in classes
        ]
    )
    return df.groupBy(*by).agg(cells.alias("_cells")).select(*by, F.inline("_cells"))


def normalized_rows(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cell shares of each actual class; the matrix has one row per cell."""
    row_total = F.sum("n").over(Window.partitionBy(*by, "actual"))
    return matrix.withColumn("row_share", F.try_divide(F.col("n"), row_total))


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _class_counts(actual: str, predicted: str, classes: Sequence[int]):
    """One (class, hits, predicted, actual) aggregate per class."""
    is_class = [(c, F.col(actual) == c, F.col(predicted) == c) for c in classes]
    return F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.count_if(real & called).alias("hits"),
                F.count_if(called).alias("called"),
                F.count_if(real).alias("real"),
            )
            for c, real, called in is_class
        ]
    )


def _measures(hits, called, real) -> dict:
    return {
        "precision": _ratio(hits, called),
        "recall": _ratio(hits, real),
        "f1": _ratio(2 * hits, called + real),
    }


def class_report(
    df: DataFrame, actual: str, predicted: str, classes: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall and F1 of each class; a ratio without a base is 0."""
    counts = df.groupBy(*by).agg(_class_counts(actual, predicted, classes).alias("_c"))
    measures = _measures(F.col("hits"), F.col("called"), F.col("real"))
    return counts.select(*by, F.inline("_c")).select(
        *by, "class", F.col("real").alias("actual_n"), *[m.alias(name) for name, m in measures.items()]
    )


def macro_metrics(
    df: DataFrame, actual: str, predicted: str, classes: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy over all rows and the plain mean of the class metrics, in one aggregation."""
    table = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(actual) == F.col(predicted), 1.0).otherwise(0.0)).alias("accuracy"),
        _class_counts(actual, predicted, classes).alias("_c"),
    )

    def mean_of(name: str):
        each = F.transform("_c", lambda c: _measures(c["hits"], c["called"], c["real"])[name])
        return F.aggregate(each, F.lit(0.0), lambda total, x: total + x) / len(classes)

    return table.select(*by, "n", "accuracy", *[mean_of(m).alias(m) for m in ("precision", "recall", "f1")])
