"""Split and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.functions.expressions import hash_share
from planshift.functions.fixed_values import POSITIVE_CLASS_WEIGHT, SPLIT_SEED, TEST_SHARE


def mark_split(df: DataFrame, keys: Sequence[str], test_share: float = TEST_SHARE, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``split``: ``test`` for the share of keys whose hash falls below it, else ``train``.

    A row keeps its side however the data is partitioned or extended.
    """
    below = hash_share([F.col(k) for k in keys], seed) < test_share
    return df.withColumn("split", F.when(below, "test").otherwise("train"))


def train_test(df: DataFrame, keys: Sequence[str], test_share: float = TEST_SHARE, seed: int = SPLIT_SEED):
    marked = mark_split(df, keys, test_share, seed)
    return tuple(marked.filter(F.col("split") == side).drop("split") for side in ("train", "test"))


def mark_folds(df: DataFrame, keys: Sequence[str], folds: int, seed: int, name: str = "fold") -> DataFrame:
    share = hash_share([F.col(k) for k in keys], seed)
    return df.withColumn(name, F.floor(share * folds).cast("int"))


def positive_weight(df: DataFrame, label: str, weight: float = POSITIVE_CLASS_WEIGHT, name: str = "weight") -> DataFrame:
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)))


def balanced_weight(df: DataFrame, label: str, classes: Sequence, name: str = "weight") -> DataFrame:
    """Weight n / (classes present * rows of the class); rows of other labels get NULL.

    The class counts are one aggregation with one number per listed class.
    """
    counts = df.agg(*[F.count_if(F.col(label) == c).alias(f"c{i}") for i, c in enumerate(classes)]).first()
    present = {c: counts[f"c{i}"] for i, c in enumerate(classes) if counts[f"c{i}"]}
    total = sum(present.values())
    expr = F
    for c, n in present.items():
        expr = expr.when(F.col(label) == c, F.lit(total / (len(present) * n)))
    return df.withColumn(name, expr.otherwise(F.lit(None).cast("double")) if present else F.lit(None).cast("double"))
