"""Training and evaluation jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from planshift.functions.fixed_values import SPLIT_SEED, TEST_SHARE
from planshift.models.evaluation import (
    sample_confusion,
    sample_gains,
    sample_report,
    score_samples,
)
from planshift.models.families import fit
from planshift.operators.sampling import balanced_weight, positive_weight, train_test
from planshift.sources.tables import pinned

# families that weigh the classes, and how
WEIGHTED = {"boosted_trees": "positive", "balanced_forest": "balanced"}


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    train: DataFrame
    test: DataFrame


def weighted(df: DataFrame, label: str, family: str) -> tuple[DataFrame, str | None]:
    """The frame with the family's class weights, and the weight column if there is one."""
    kind = WEIGHTED.get(family)
    if kind == "positive":
        return positive_weight(df, label), "weight"
    if kind == "balanced":
        return balanced_weight(df, label, (0, 1)), "weight"
    return df, None


def train(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    family: str,
    test_share: float = TEST_SHARE,
    seed: int = SPLIT_SEED,
    **params,
) -> Trained:
    """Split by key hash, weigh the classes as the family does, fit on the training side."""
    train_side, test_side = train_test(df, keys, test_share, seed)
    rows, weight = weighted(train_side, label, family)
    return Trained(fit(rows, features, label, family, weight=weight, **params), train_side, test_side)


def score_and_evaluate(
    model: PipelineModel, samples: Mapping[str, DataFrame], label: str, keys: Sequence[str]
) -> dict[str, DataFrame]:
    """Scores of all samples in one pass, with report, confusion matrix and gains per sample.

    The scores are stored once, the tables read them from there instead of scoring again.
    """
    scored = pinned(score_samples(model, samples, [*keys, label]))
    gains = sample_gains(scored, label, keys)
    return {
        "scores": scored,
        "report": sample_report(scored, label, keys, gains),
        "confusion": sample_confusion(scored, label),
        "gains": gains,
    }
