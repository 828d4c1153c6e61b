"""Fits, selection and explanation: properties rather than numbers."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from planshift.catalog import ENTRIES
from planshift.models import explain as X
from planshift.models import families, selection
from planshift.models.evaluation import compare_families, score_samples
from planshift.models.families import FAMILIES, fit, fit_per_class, score, score_per_class, stages, tree_ensemble
from planshift.models.selection import backward_elimination, genetic_search, mask_names, select_by_genetic_search
from planshift.operators.gains import area_under_curve
from planshift.plans.selection import select_features
from planshift.plans.training import score_and_evaluate, train
from planshift.sources.tables import load_model, save_model

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = pd.DataFrame(rng.normal(size=(600, 4)), columns=FEATURES)
    x["a"] = x["a"].round(1)
    x["y"] = ((1.5 * x.a - x.b + 0.3 * rng.normal(size=600)) > 0).astype(int)
    x["id"] = range(600)
    return x


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(4).cache()


SMALL = {
    "importance_forest": {"numTrees": 5, "seed": 1}, "balanced_forest": {"numTrees": 5}, "boosted_trees": {"maxIter": 4},
    "boosted_trees_deep": {"maxIter": 4}, "logistic": {}, "neural": {"hidden": (5,), "maxIter": 30},
}


@pytest.mark.parametrize("family", FAMILIES)
def test_family_learns_and_scores_whole(df, family):
    done = train(df, FEATURES, "y", ["id"], family, **SMALL[family])
    scored = score_samples(done.model, {"train": done.train, "test": done.test}, ["id", "y"])
    assert scored.count() == 600 and scored.select("id").distinct().count() == 600
    assert scored.filter(~F.col("p").between(0, 1)).count() == 0
    areas = {r["sample"]: r["auc"] for r in area_under_curve(scored, "p", "y", ["sample"]).collect()}
    assert areas["train"] > 0.85 and areas["test"] > 0.8


def test_default_settings():
    def settings(family):
        model = stages(family, FEATURES, "y", rows=100)[-1]
        return {p.name: v for p, v in model.extractParamMap().items()}

    boosted = settings("boosted_trees")
    assert (boosted["maxIter"], boosted["maxDepth"], boosted["stepSize"]) == (400, 3, 0.02)
    deep = settings("boosted_trees_deep")
    assert (deep["maxIter"], deep["stepSize"], deep["minInstancesPerNode"]) == (1000, 0.03, 2)
    forest = settings("balanced_forest")
    assert (forest["numTrees"], forest["maxDepth"], forest["featureSubsetStrategy"]) == (200, 3, "sqrt")
    assert settings("importance_forest")["maxDepth"] == 4
    assert settings("logistic")["regParam"] == pytest.approx(0.01)
    assert settings("neural")["layers"] == [4, 100, 100, 2]


def test_logistic_equals_newton(df, data):
    model = fit(df, FEATURES, "y", "logistic", maxIter=200, tol=1e-12).stages[-1]
    x = np.column_stack([data[FEATURES], np.ones(len(data))])
    w, ridge = np.zeros(5), np.diag([1.0, 1, 1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - data.y) + ridge @ w)
    assert np.allclose([*model.coefficients.toArray(), model.intercept], w, atol=1e-4)


def test_rare_positives_keep_their_ranking(spark):
    """Leaves that all vote for the common class still tell the shares apart."""
    rows = [(float(i % 10), int(i % 10 > 7 and i % 3 == 0), i) for i in range(900)]
    df = spark.createDataFrame(rows, "a double, y int, id int")
    model = fit(df, ["a"], "y", "importance_forest", numTrees=5, seed=1)
    shares = {r["a"]: r["p"] for r in score(model, df, ["a"]).distinct().collect()}
    assert max(shares.values()) < 0.5
    assert min(shares[8.0], shares[9.0]) > 0.2 and max(shares[v] for v in (0.0, 3.0, 5.0)) < 0.05


def test_three_class_forest(df):
    rows = df.withColumn("k", F.when(F.col("a") > 0.5, 2).when(F.col("b") > 0, 1).otherwise(0))
    model = fit(rows, FEATURES, "k", "importance_forest", classes=3, numTrees=5, seed=1)
    scored = score(model, rows, ["id", "k"], classes=3)
    assert scored.columns == ["id", "k", "pred", "p_0", "p_1", "p_2"]
    assert scored.filter("k = pred").count() > 400


def test_saved_model_scores_alike(df, tmp_path):
    model = fit(df, FEATURES, "y", "boosted_trees", maxIter=3)
    save_model(model, str(tmp_path / "model"))
    before, after = (score(m, df, ["id"]) for m in (model, load_model(str(tmp_path / "model"))))
    assert before.exceptAll(after).count() == 0


def test_missing_feature_is_an_error(df):
    holed = df.withColumn("a", F.when(F.col("id") > 5, F.col("a")))
    with pytest.raises(Exception, match="null"):
        fit(holed, FEATURES, "y", "logistic")


def test_per_class_models(df):
    rows = df.withColumn("k", F.when(F.col("a") > 1, 3).when(F.col("b") > 0, 2).otherwise(1))
    models = fit_per_class(rows, FEATURES, "k", [1, 2, 3], "logistic")
    scored = score_per_class(models, rows, ["id", "k"])
    assert scored.columns == ["id", "k", "score_1", "score_2", "score_3"] and scored.count() == 600
    means = {r["k"]: r["m"] for r in scored.groupBy("k").agg(F.avg("score_3").alias("m")).collect()}
    assert means[3] > max(means[1], means[2])


def test_elimination(df):
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=5, seed=1)
    found = backward_elimination(df, FEATURES, "y", forest, 2)
    assert len(found.kept) <= 2 and found.kept[0] in ("a", "b")
    dropped = [name for _, names in found.rounds for name in names]
    assert sorted(found.kept + dropped) == FEATURES
    untouched = backward_elimination(df, FEATURES, "y", forest, 4)
    assert (untouched.kept, untouched.rounds) == (FEATURES, [])


def test_elimination_with_equal_importances(spark):
    flat = spark.createDataFrame([(1.0, 1.0, 0), (1.0, 1.0, 1)] * 5, "a double, b double, y int")
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=2, seed=1)
    assert backward_elimination(flat, ["a", "b"], "y", forest, 1).kept == []


def test_genetic_search_finds_the_planted_mask():
    wanted, asked = {1, 4, 7}, []

    def fitness(masks):
        asked.extend(masks)
        chosen = [{i for i, on in enumerate(m) if on} for m in masks]
        return [len(c & wanted) - 0.1 * len(c - wanted) for c in chosen]

    found = genetic_search(10, fitness, seed=3, generations=60, patience=30)
    assert {i for i, on in enumerate(found.mask) if on} == wanted
    assert len(asked) == len(set(asked)) == found.evaluated
    assert all(1 <= sum(m) <= 5 for m in asked)
    assert mask_names(found.mask, list("abcdefghij")) == ["b", "e", "h"]


def test_genetic_search_stops_when_flat():
    found = genetic_search(6, lambda masks: [1.0] * len(masks), generations=40, patience=3)
    assert found.generations == 3


def test_genetic_search_goes_on_from_known_scores():
    def fitness(masks):
        asked.extend(masks)
        return [sum(m) - 2.0 * m[3] for m in masks]

    asked = []
    whole = genetic_search(8, fitness, seed=5)
    first = dict(list(whole.scores.items())[:60])
    asked = []
    again = genetic_search(8, fitness, seed=5, scored=first)
    assert (again.mask, again.scores, again.generations) == (whole.mask, whole.scores, whole.generations)
    assert not set(asked) & set(first) and set(asked) | set(first) == set(whole.scores)


def test_genetic_search_takes_the_smallest_of_equal_masks():
    found = genetic_search(5, lambda masks: [float(m[1] or m[4]) for m in masks], seed=1)
    assert mask_names(found.mask, "abcde") == ["b"]


def test_genetic_selection_takes_up_its_memo(df, tmp_path, monkeypatch):
    forest = tree_ensemble("balanced_forest", "y", numTrees=1)
    settings = {"folds": 2, "population": 5, "generations": 1, "max_features": 2, "memo": str(tmp_path / "memo")}
    names, found = select_by_genetic_search(df, FEATURES, "y", ["id"], forest, **settings)
    monkeypatch.setattr(selection, "CrossValidator", None)  # nothing is left to fit
    again, second = select_by_genetic_search(df, FEATURES, "y", ["id"], forest, **settings)
    assert again == names and second.scores == found.scores


def test_genetic_selection_on_spark(df):
    forest = tree_ensemble("balanced_forest", "y", numTrees=3)
    names, found = select_by_genetic_search(df, FEATURES, "y", ["id"], forest, folds=2, population=4, generations=1, max_features=2)
    assert 1 <= len(names) <= 2 and 0.4 < found.fitness <= 1


def test_select_features_methods(df):
    assert select_features(df, FEATURES, "y", "collinearity") == FEATURES
    assert len(select_features(df, FEATURES, "y", "importance", size=2, numTrees=5, seed=1)) <= 2
    grouped = df.withColumns({f: F.when(F.col(f) > 0, 1).otherwise(0) for f in FEATURES})
    assert select_features(grouped, FEATURES, "y", "information", top=1) == ["a"]
    with pytest.raises(ValueError):
        select_features(df, FEATURES, "y", "guess")


def brute_force(nodes, x, width):
    """Shapley values by listing all feature sets, with cover-weighted descent for unknown features."""
    by_place = {(n["tree"], n["node"]): n for n in nodes}

    def value(tree, node, known):
        n = by_place[(tree, node)]
        if n["left"] is None:
            return n["value"]
        if n["feature_index"] in known:
            return value(tree, n["left"] if x[n["feature_index"]] <= n["threshold"] else n["right"], known)
        return sum(
            by_place[(tree, child)]["cover"] / n["cover"] * value(tree, child, known) for child in (n["left"], n["right"])
        )

    trees = {t for t, _ in by_place}
    total = {s: sum(value(t, 0, s) for t in trees) for k in range(width + 1) for s in map(frozenset, combinations(range(width), k))}
    out = []
    for i in range(width):
        rest = [s for s in total if i not in s]
        weight = [math.factorial(len(s)) * math.factorial(width - len(s) - 1) / math.factorial(width) for s in rest]
        out.append(sum(w * (total[s | {i}] - total[s]) for s, w in zip(rest, weight)))
    return out


@pytest.mark.parametrize("family, params, tabulated", [
    ("boosted_trees", {"maxIter": 3, "maxDepth": 4}, 8),
    ("boosted_trees", {"maxIter": 3, "maxDepth": 4}, 1),
    ("importance_forest", {"numTrees": 4, "maxDepth": 3, "seed": 1}, 8),
])
def test_contributions_equal_brute_force(df, family, params, tabulated, monkeypatch):
    monkeypatch.setattr(X, "TABULATED", tabulated)
    model = fit(df, FEATURES, "y", family, **params)
    nodes = X.node_table(model, df.sparkSession)
    found = X.tree_contributions(df, nodes, FEATURES, ["id"]).orderBy("id").collect()
    scores = {r["id"]: r["p"] for r in score(model, df, ["id"]).collect()}
    inputs = {r["id"]: [r[f] for f in FEATURES] for r in df.collect()}
    assert len(found) == 600
    for row in random.Random(0).sample(found, 5):
        expected = brute_force(nodes.collect(), inputs[row["id"]], 4)
        assert np.allclose([row[f"c_{f}"] for f in FEATURES], expected)
    for row in found:
        share = 1 / (1 + math.exp(-2 * row["margin"])) if family == "boosted_trees" else row["margin"]
        assert share == pytest.approx(scores[row["id"]], abs=1e-9)


def test_tree_of_few_splits_is_one_look_up():
    """The table of a whole tree at the row's outcome equals the sum over its paths."""

    def node(place, left=None, right=None, feature=None, cut=None, cover=1.0, value=0.0):
        return {
            "tree": 0, "node": place, "left": left, "right": right, "feature_index": feature, "threshold": cut,
            "categories": -1, "cover": cover, "value": value,
        }

    # feature 0 twice on one path, feature 2 on the other side only
    tree = [
        node(0, 1, 4, 0, 1.0, 10.0), node(1, 2, 3, 0, 0.0, 6.0), node(2, cover=2.0, value=0.5), node(3, cover=4.0, value=-0.25),
        node(4, 5, 6, 2, 2.0, 4.0), node(5, cover=3.0, value=2.0), node(6, cover=1.0, value=-1.0),
    ]
    paths, splits = X._leaf_paths(tree), [(0, 0.0), (0, 1.0), (2, 2.0)]
    features, table = X._tree_table(paths, splits)
    assert features == [0, 2] and table.shape == (2, 8)
    for row in ([-1.0, 9.0, 2.0], [0.0, 9.0, 3.0], [0.5, 9.0, 1.0], [1.0, 9.0, 5.0], [1.5, 9.0, 2.0], [2.0, 9.0, 2.5]):
        outcome = sum((row[f] > cut) << i for i, (f, cut) in enumerate(splits))
        whole = np.zeros(3)
        for value, used, low, high, share in paths:
            x = np.array(row)[used]
            whole[used] += value * X._path_shares(((x > low) & (x <= high)).astype(float)[None], share)[0]
        assert np.allclose([whole[0], whole[2]], table[:, outcome]) and whole[1] == 0


def test_importances_and_split_counts(df):
    model = fit(df, FEATURES, "y", "boosted_trees", maxIter=4)
    spark = df.sparkSession
    gains = {r["feature"]: r["importance"] for r in X.importance_table(model, FEATURES, spark).collect()}
    assert sum(gains.values()) == pytest.approx(1)
    nodes = X.node_table(model, spark)
    splits = {r["feature"]: r["splits"] for r in X.split_counts(nodes, FEATURES).collect()}
    assert sum(splits.values()) == nodes.filter("left is not null").count()
    assert all((gains[f] > 0) == (splits[f] > 0) for f in FEATURES)


def test_linear_contributions_add_up(df):
    weights = {"a": 2.0, "b": -1.0}
    parts = X.linear_contributions(df, weights, ["id"], intercept=0.5).join(df.select("id", "a", "b"), "id")
    off = parts.filter(F.abs(F.col("margin") - (0.5 + 2 * F.col("a") - F.col("b"))) > 1e-9)
    assert off.count() == 0
    table = X.mean_absolute(parts, ["a", "b"]).collect()
    assert [r["feature"] for r in table] == ["a", "b"]


def test_evaluation_tables(df):
    done = train(df, FEATURES, "y", ["id"], "logistic")
    sides = {"train": done.train, "test": done.test}
    tables = score_and_evaluate(done.model, sides, "y", ["id"])
    report = {r["sample"]: r for r in tables["report"].collect()}
    assert set(report) == {"train", "test"} and report["train"]["n"] + report["test"]["n"] == 600
    assert report["test"]["accuracy"] > 0.8 and report["test"]["ks"] > 50
    gains = tables["gains"].filter("sample = 'train' and decile = 1").first()
    assert gains["lift"] > 1.5
    both = compare_families({"x": done.model, "z": done.model}, sides, "y", ["id"]).collect()
    assert len(both) == 4 and len({r["ks"] for r in both if r["sample"] == "test"}) == 1


@pytest.mark.parametrize("name", [
    "families_compared", "gain_importance", "split_count_importance", "tree_contributions", "tree_contributions_add_up",
    "development_job", "explanation_job", "deep_boosted_tree_scores",
])
def test_boosted_queries_run_all_rounds(spark, small, monkeypatch, name):
    """The settings that reach the fit; the fit itself is left out."""

    class Reached(Exception):
        pass

    made = families.tree_ensemble

    def noted(family, *args, **params):
        if family.startswith("boosted_trees"):
            raise Reached(made(family, *args, **params).getMaxIter())
        return made(family, *args, **{**params, "numTrees": 1})

    monkeypatch.setattr(families, "tree_ensemble", noted)
    with pytest.raises(Reached) as reached:
        ENTRIES[name].build(spark, small)
    assert reached.value.args == (1000 if name == "deep_boosted_tree_scores" else 400,)
