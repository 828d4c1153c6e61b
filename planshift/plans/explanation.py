"""Explanation job: global importances and per-row contributions of a tree model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from planshift.models.explain import (
    importance_table,
    mean_absolute,
    node_table,
    split_counts,
    tree_contributions,
)


def explain(model: PipelineModel, df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> dict[str, DataFrame]:
    spark = df.sparkSession
    nodes = node_table(model, spark)
    rows = tree_contributions(df, nodes, features, keys)
    return {
        "importance": importance_table(model, features, spark),
        "split_counts": split_counts(nodes, features),
        "contributions": rows,
        "mean_absolute": mean_absolute(rows, features),
    }
