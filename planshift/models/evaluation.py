"""Evaluation of fitted models over several samples, and comparison of families."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.models.families import score
from planshift.operators.gains import area_under_curve, gains_table, ks_distance
from planshift.operators.metrics import confusion_matrix, macro_metrics
from planshift.sources.tables import pinned


def stack_samples(samples: Mapping[str, DataFrame]) -> DataFrame:
    """One frame of all samples, told apart by ``sample``."""
    tagged = [df.withColumn("sample", F.lit(name)) for name, df in samples.items()]
    return reduce(DataFrame.unionByName, tagged)


def score_samples(model: PipelineModel, samples: Mapping[str, DataFrame], keep: Sequence[str]) -> DataFrame:
    """Score all samples in one pass."""
    return score(model, stack_samples(samples), ["sample", *keep])


def sample_metrics(scored: DataFrame, actual: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    return macro_metrics(scored, actual, "pred", classes, ["sample"])


def sample_confusion(scored: DataFrame, actual: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    return confusion_matrix(scored, actual, "pred", classes, ["sample"])


def sample_gains(scored: DataFrame, actual: str, keys: Sequence[str]) -> DataFrame:
    return gains_table(scored, "p", actual, keys, ["sample"])


def sample_report(
    scored: DataFrame, actual: str, keys: Sequence[str], gains: DataFrame | None = None
) -> DataFrame:
    """Accuracy, macro metrics, KS and area under the curve per sample; one row per sample joins.

    Give the gains table if it is there already: the scores are then not ranked again.
    """
    distances = ks_distance(sample_gains(scored, actual, keys) if gains is None else gains, ["sample"])
    areas = area_under_curve(scored, "p", actual, ["sample"])
    return sample_metrics(scored, actual).join(distances, "sample").join(areas, "sample")


def compare_families(
    models: Mapping[str, PipelineModel], samples: Mapping[str, DataFrame], actual: str, keys: Sequence[str]
) -> DataFrame:
    """One tidy row per family and sample; every model scores every row once."""
    scored = [
        score_samples(model, samples, [*keys, actual]).withColumn("family", F.lit(name))
        for name, model in models.items()
    ]
    every = pinned(reduce(DataFrame.unionByName, scored))
    metrics = macro_metrics(every, actual, "pred", (0, 1), ["family", "sample"])
    gains = gains_table(every, "p", actual, keys, ["family", "sample"])
    areas = area_under_curve(every, "p", actual, ["family", "sample"])
    keys_of = ["family", "sample"]
    return metrics.join(ks_distance(gains, keys_of), keys_of).join(areas, keys_of)
