"""Importance of features and additive contributions of each feature to each score."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planshift.session import work_path

# Trees of at most this many different splits get all their outcomes tabulated.
TABULATED = 8


def importance_table(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance) by impurity gain, highest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), F.col("feature"))


def node_table(model: PipelineModel, spark) -> DataFrame:
    """Nodes of all trees of a fitted ensemble: split feature and threshold, or leaf value.

    ``value`` is what a leaf adds to the score: its weighted prediction for boosting, its
    share of class 1 over the number of trees for a two-class forest.
    """
    ensemble = model.stages[-1]
    if getattr(ensemble, "numClasses", 2) > 2:
        raise ValueError("forests of more than two classes have no single score; explain one class against the rest")
    path = work_path(spark, "trees")
    ensemble.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    boosted = ensemble.hasParam("stepSize")
    shares = ensemble.treeWeights if boosted else [1.0 / ensemble.getNumTrees] * ensemble.getNumTrees
    weights = F.array(*[F.lit(float(w)) for w in shares])
    value = F.col("prediction") * F.element_at(weights, F.col("treeID") + 1)
    is_leaf = F.col("leftChild") < 0
    return nodes.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(~is_leaf, F.col("leftChild")).alias("left"),
        F.when(~is_leaf, F.col("rightChild")).alias("right"),
        F.when(~is_leaf, F.col("split.featureIndex")).alias("feature_index"),
        F.when(~is_leaf, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(~is_leaf, F.col("split.numCategories")).alias("categories"),
        F.col("rawCount").cast("double").alias("cover"),
        value.alias("value"),
    )


def split_counts(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, splits): how often each feature is split on; unused features count 0."""
    entries = [
        F.struct(F.lit(f).alias("feature"), F.count_if(F.col("feature_index") == i).alias("splits"))
        for i, f in enumerate(features)
    ]
    table = nodes.agg(F.array(*entries).alias("_rows")).select(F.inline("_rows"))
    return table.orderBy(F.col("splits").desc(), F.col("feature"))


def _leaf_paths(nodes: Sequence) -> list[tuple]:
    """(leaf value, features, lower bounds, upper bounds, cover shares) of each root-to-leaf path."""
    by_place = {(n["tree"], n["node"]): n for n in nodes}
    paths = []
    pending = [(n, {}) for (_, node), n in by_place.items() if node == 0]
    while pending:
        node, seen = pending.pop()
        if node["left"] is None:
            names = sorted(seen)
            low, high, share = (np.array([seen[f][k] for f in names]) for k in range(3))
            paths.append((node["value"], np.array(names, dtype=int), low, high, share))
            continue
        if node["categories"] != -1:
            raise ValueError("splits on nominal features are not explained; assemble them as numbers")
        f, cut = node["feature_index"], node["threshold"]
        low, high, share = seen.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in (("left", (low, min(high, cut))), ("right", (max(low, cut), high))):
            branch = by_place[(node["tree"], node[child])]
            grown = {**seen, f: (*bounds, share * branch["cover"] / node["cover"])}
            pending.append((branch, grown))
    return paths


def _path_shares(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley share of each path feature; ``inside`` tells per row which features stay on the path.

    A feature that is known counts as its own outcome (1 on the path, else 0), an unknown one
    as the share of training rows that go this way; sets of known features are weighted by
    size, for which the coefficients of prod(share + inside * t) are enough.
    """
    rows, d = inside.shape
    out = np.empty((rows, d))
    weights = np.array([1.0 / (d * comb(d - 1, k)) for k in range(d)])
    for i in range(d):
        poly = np.zeros((rows, d))
        poly[:, 0] = 1.0
        for j in range(d):
            if j != i:
                shifted = np.zeros_like(poly)
                shifted[:, 1:] = poly[:, :-1] * inside[:, j : j + 1]
                poly = poly * share[j] + shifted
        out[:, i] = (inside[:, i] - share[i]) * (poly @ weights)
    return out


def _tree_table(paths: Sequence[tuple], splits: Sequence[tuple]) -> tuple[list[int], np.ndarray]:
    """Features of a tree, and the contribution of each of them at every outcome of its splits.

    Bit i of an outcome tells that the row lies above ``splits[i]``, a (feature, threshold).
    """
    bits = (np.arange(1 << len(splits))[:, None] >> np.arange(len(splits))) & 1
    at = {split: i for i, split in enumerate(splits)}
    features = sorted({f for f, _ in splits})
    table = np.zeros((len(features), len(bits)))
    for value, used, low, high, share in paths:
        inside = np.ones((len(bits), len(used)))
        for k, f in enumerate(used):
            if low[k] > -np.inf:
                inside[:, k] *= bits[:, at[(f, low[k])]]
            if high[k] < np.inf:
                inside[:, k] *= 1 - bits[:, at[(f, high[k])]]
        if len(used):
            table[[features.index(f) for f in used]] += value * _path_shares(inside, share).T
    return features, table


def tree_contributions(
    df: DataFrame, nodes: DataFrame, features: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Per row: keys, one contribution per feature, ``base_value`` and ``margin`` (their sum).

    Path-dependent Shapley values of the tree ensemble.  The node table is bounded by the
    model (trees times nodes per tree), not by the data; rows are handled in Arrow batches
    where they are, without a shuffle.  A tree of few splits is one look-up per row and feature;
    larger ones are gone through path by path.
    """
    by_tree: dict[int, list] = {}
    for node in nodes.collect():
        by_tree.setdefault(node["tree"], []).append(node)
    base, cuts, tables, paths = 0.0, {}, [], []
    for tree in by_tree.values():
        found = _leaf_paths(tree)
        base += float(sum(value * share.prod() for value, _, _, _, share in found))
        splits = sorted({(n["feature_index"], n["threshold"]) for n in tree if n["left"] is not None})
        if len(splits) <= TABULATED:
            places = [cuts.setdefault(split, len(cuts)) for split in splits]
            tables.append((places, *_tree_table(found, splits)))
        else:
            paths += [p for p in found if len(p[1])]
    keys, features, cuts = list(keys), list(features), list(cuts)

    def contributions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(dtype=float)
            if np.isnan(x).any():
                raise ValueError("a feature is missing; rows with missing features can be neither scored nor explained")
            columns = np.ascontiguousarray(x.T)
            phi = np.zeros_like(columns)
            above = [(columns[f] > cut).astype(np.int64) for f, cut in cuts]
            for places, used, table in tables:
                code = np.zeros(len(x), np.int64)
                for bit, place in enumerate(places):
                    code += above[place] << bit
                for f, row in zip(used, table):
                    phi[f] += row[code]
            for value, used, low, high, share in paths:
                inside = (x[:, used] > low) & (x[:, used] <= high)
                phi[used] += value * _path_shares(inside.astype(float), share).T
            out = batch[keys].copy()
            for name, part in zip(features, phi):
                out[f"c_{name}"] = part
            out["base_value"] = base
            out["margin"] = base + phi.sum(axis=0)
            yield out

    fields = [df.schema[k] for k in keys]
    fields += [T.StructField(f"c_{f}", T.DoubleType()) for f in features]
    fields += [T.StructField(n, T.DoubleType()) for n in ("base_value", "margin")]
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    return df.select(*keys, *numbers).mapInPandas(contributions, T.StructType(fields))


def linear_contributions(
    df: DataFrame, weights: Mapping[str, float], keys: Sequence[str], intercept: float = 0.0
) -> DataFrame:
    """Closed form for linear scores: weight times distance from the column mean."""
    features = list(weights)
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    centre = {f: means[f] or 0.0 for f in features}
    parts = [(F.lit(float(w)) * (F.col(f) - F.lit(centre[f]))).alias(f"c_{f}") for f, w in weights.items()]
    base = intercept + sum(w * centre[f] for f, w in weights.items())
    out = df.select(*keys, *parts, F.lit(base).alias("base_value"))
    return out.withColumn("margin", sum((F.col(f"c_{f}") for f in features), F.col("base_value")))


def mean_absolute(contributions: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean_abs): average size of each feature's contribution, highest first."""
    entries = [
        F.struct(F.lit(f).alias("feature"), F.avg(F.abs(F.col(f"c_{f}"))).alias("mean_abs")) for f in features
    ]
    table = contributions.agg(F.array(*entries).alias("_rows")).select(F.inline("_rows"))
    return table.orderBy(F.col("mean_abs").desc(), F.col("feature"))
