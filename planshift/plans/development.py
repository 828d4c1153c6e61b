"""The whole modelling run: prepare, split, fit, score and evaluate development and later tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from planshift.functions.fixed_values import SPLIT_SEED, TEST_SHARE
from planshift.plans.prepare import PrepSpec, fit_prep, prepare, training_matrix
from planshift.plans.training import score_and_evaluate, train
from planshift.sources.tables import pinned


@dataclass(frozen=True)
class Development:
    model: PipelineModel
    spec: PrepSpec  # with the column types pinned on the development table
    samples: dict[str, DataFrame]  # prepared matrices: train, test and the later ones
    tables: dict[str, DataFrame]  # scores, report, confusion, gains


def develop(
    development: DataFrame,
    later: Mapping[str, DataFrame],
    features: Sequence[str],
    spec: PrepSpec,
    family: str,
    test_share: float = TEST_SHARE,
    seed: int = SPLIT_SEED,
    **params,
) -> Development:
    """Fit ``family`` on the development table and evaluate it there and on every later table.

    Later tables go through the same preparation, with the column types of the development
    table.  Each matrix keeps one row per combination of features and label.
    """
    fitted = fit_prep(development, spec)

    def matrix(raw: DataFrame) -> DataFrame:
        return pinned(training_matrix(prepare(raw, fitted), features, fitted))

    keys = list(fitted.keys)
    done = train(matrix(development), features, fitted.label, keys, family, test_share, seed, **params)
    samples = {"train": done.train, "test": done.test, **{name: matrix(raw) for name, raw in later.items()}}
    return Development(done.model, fitted, samples, score_and_evaluate(done.model, samples, fitted.label, keys))
