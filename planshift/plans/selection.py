"""Selection job: reduce a feature list by importance, collinearity, evidence or genetic search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.functions.fixed_values import VIF_LIMIT
from planshift.models.families import tree_ensemble
from planshift.models.selection import backward_elimination, select_by_genetic_search
from planshift.operators.collinearity import prune_collinear
from planshift.operators.encoding import information_value, weight_of_evidence
from planshift.operators.sampling import balanced_weight

METHODS = ("importance", "collinearity", "genetic", "information")


def select_features(
    df: DataFrame, features: Sequence[str], label: str, method: str, keys: Sequence[str] = (), **options
) -> list[str]:
    """Names of the kept features.

    ``importance``: ``size`` (12) and forest settings.  ``collinearity``: ``limit`` (10),
    ``centred``.  ``genetic``: search settings and ``forest`` settings.  ``information``:
    ``top`` categories by information value for the positive class.
    """
    features = list(features)
    if method == "importance":
        size = options.pop("size", 12)
        forest = tree_ensemble("importance_forest", label, **options)
        return backward_elimination(df, features, label, forest, size).kept
    if method == "collinearity":
        return prune_collinear(df, features, options.pop("limit", VIF_LIMIT), **options)[0]
    if method == "genetic":
        forest = tree_ensemble("balanced_forest", label, "weight", **options.pop("forest", {}))
        weighed = balanced_weight(df, label, (0, 1))
        return select_by_genetic_search(weighed, features, label, keys, forest, weight="weight", **options)[0]
    if method == "information":
        ranked = information_value(weight_of_evidence(df, features, label, [1]))
        best = ranked.orderBy(F.col("iv").desc(), "variable").limit(min(options.pop("top", 12), len(features)))
        return [r["variable"] for r in best.collect()]  # at most one row per feature
    raise ValueError(f"unknown method {method!r}; known: {METHODS}")
