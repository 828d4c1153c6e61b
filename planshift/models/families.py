"""The model families and how they are fitted and applied.

Two-class forests are regression forests on the 0/1 label.  Variance splits are the Gini
splits, and the forest's mean leaf value is the share of class 1.  A classification forest
would merge sibling leaves that vote alike, which flattens the shares that deciles, lift and
importances are read off.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planshift.functions.fixed_values import (
    BALANCED_FOREST,
    BOOSTED_TREES,
    BOOSTED_TREES_DEEP,
    IMPORTANCE_FOREST,
    LOGISTIC_C,
    NEURAL_HIDDEN,
    NEURAL_MAX_ITER,
)
from planshift.models.boosting import BoostedTrees
from planshift.session import shared_folder

DEFAULTS = {
    "importance_forest": (RandomForestRegressor, IMPORTANCE_FOREST),
    "balanced_forest": (RandomForestRegressor, BALANCED_FOREST),
    "boosted_trees": (BoostedTrees, BOOSTED_TREES),
    "boosted_trees_deep": (BoostedTrees, BOOSTED_TREES_DEEP),
}
FAMILIES = (*DEFAULTS, "logistic", "neural")


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Feature vector column; a missing value is an error, not a dropped row."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error").transform(df)


def tree_ensemble(family: str, label: str, weight: str | None = None, classes: int = 2, **params) -> Estimator:
    """Unfitted ensemble with the family's settings, each of which can be overridden."""
    kind, defaults = DEFAULTS[family]
    if kind is RandomForestRegressor and classes > 2:
        kind = RandomForestClassifier
    settings = {**defaults, **params}
    if weight:
        settings["weightCol"] = weight
    return kind(labelCol=label, featuresCol="features", **settings)


def stages(
    family: str, features: Sequence[str], label: str, rows: int, classes: int = 2, weight: str | None = None, **params
) -> list[Estimator]:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    if family in DEFAULTS:
        return [assembler, tree_ensemble(family, label, weight, classes, **params)]
    if family == "logistic":
        # L2 strength of the "C" parameterisation: the penalty is shared by all rows
        c = params.pop("C", LOGISTIC_C)
        settings = {"regParam": 1.0 / (c * max(rows, 1)), "elasticNetParam": 0.0, "standardization": False, **params}
        if weight:
            settings["weightCol"] = weight
        return [assembler, LogisticRegression(labelCol=label, featuresCol="features", **settings)]
    if family == "neural":
        hidden = params.pop("hidden", NEURAL_HIDDEN)
        settings = {"maxIter": NEURAL_MAX_ITER, "seed": 1, **params}
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
        layers = [len(features), *hidden, classes]
        network = MultilayerPerceptronClassifier(labelCol=label, featuresCol="scaled", layers=layers, **settings)
        return [assembler, scaler, network]
    raise ValueError(f"unknown family {family!r}; known: {FAMILIES}")


def fit(
    df: DataFrame, features: Sequence[str], label: str, family: str, classes: int = 2, weight: str | None = None, **params
) -> PipelineModel:
    """Fit one family.

    Every family passes over the rows many times, so the needed columns are kept in memory
    and on disk meanwhile.  Long boosting runs cut their lineage in the shared folder.
    """
    shared_folder(df.sparkSession)
    needed = df.select(*features, label, *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = needed.count() if family == "logistic" else 0
        return Pipeline(stages=stages(family, features, label, rows, classes, weight, **params)).fit(needed)
    finally:
        needed.unpersist()


def class_one_share(model: PipelineModel) -> Column:
    """Probability of class 1 in the output of ``model``."""
    if isinstance(model.stages[-1], RandomForestRegressionModel):
        return F.col("prediction")
    return vector_to_array("probability")[1]


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], classes: int = 2) -> DataFrame:
    """Kept columns with ``pred`` and the probability of class 1 (``p``), or ``p_<class>`` for more classes."""
    scored = model.transform(df)
    if classes > 2:
        shares = [vector_to_array("probability")[i].alias(f"p_{i}") for i in range(classes)]
        return scored.select(*keep, F.col("prediction").cast("int").alias("pred"), *shares)
    rows = scored.select(*keep, class_one_share(model).alias("p"))
    return rows.select(*keep, F.when(F.col("p") > 0.5, 1).otherwise(0).alias("pred"), "p")


def fit_per_class(
    df: DataFrame, features: Sequence[str], label: str, class_values: Sequence, family: str, **params
) -> dict:
    """One binary model per listed class, this class against the rest."""
    models = {}
    for value in class_values:
        marked = df.select(*features, F.when(F.col(label) == value, 1).otherwise(0).alias("_is_class"))
        models[value] = fit(marked, features, "_is_class", family, **params)
    return models


def score_per_class(models: dict, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Kept columns with ``score_<class>`` of every model, in one pass over the rows."""
    scored = df
    made = ("features", "scaled", "rawPrediction", "probability", "prediction")
    for value, model in models.items():
        result = model.transform(scored).withColumn(f"score_{value}", class_one_share(model))
        scored = result.drop(*made)
    return scored.select(*keep, *[f"score_{v}" for v in models])
