"""Fits, scores, selection and explanation.

Fits are checked by rows here and by properties in the tests; whatever does not hang on a
fit (fixed formulas, invariants of scores and contributions) is checked by SQL.  Some
round counts are kept small, as the README lists; they are parameters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.catalog.profiles import r6, rounded
from planshift.catalog.rankings import counted, deciles, gains
from planshift.catalog.registry import query
from planshift.catalog.sql_parts import given
from planshift.models import explain as X
from planshift.models.evaluation import (
    compare_families,
    sample_confusion,
    sample_report,
    score_samples,
    stack_samples,
)
from planshift.models.families import fit, fit_per_class, score, score_per_class, tree_ensemble
from planshift.models.network import Network, fit_network, network_scores, network_share
from planshift.models.selection import backward_elimination, select_by_genetic_search
from planshift.operators.collinearity import prune_collinear
from planshift.operators.gains import class_scores, gains_table
from planshift.operators.sampling import balanced_weight, positive_weight, train_test
from planshift.sources import standins as S
from planshift.sources.tables import pinned

KEYS = ["account_id", "day"]
SAMPLES = ("dev", "oot1", "oot2")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account-day matrix, computed once for the many passes of a fit."""
    return pinned(S.activity_matrix(spark, sf_dir))


def samples(rows: DataFrame) -> dict[str, DataFrame]:
    """Training and test side of the development sample, and both out-of-time samples."""
    parts = {name: rows.filter(F.col("sample") == name).drop("sample") for name in SAMPLES}
    train, test = train_test(parts.pop("dev"), KEYS)
    return {"train": train, "test": test, **parts}


def _scores(rows: DataFrame, family: str, weigh=None, **params) -> DataFrame:
    parts = samples(rows)
    train = weigh(parts["train"]) if weigh else parts["train"]
    model = fit(train, S.FEATURES, "target", family, weight="weight" if weigh else None, **params)
    return score_samples(model, parts, [*KEYS, "target"])


@query("J1 I4 K1")
def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(samples(matrix(spark, sf_dir))["train"], S.FEATURES, "target", "importance_forest", seed=1)
    return X.importance_table(model, S.FEATURES, spark)


@query("J2 I5 J8")
def balanced_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(matrix(spark, sf_dir), "balanced_forest", lambda df: balanced_weight(df, "target", (0, 1)))


@query("J3 I5 J8")
def boosted_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(matrix(spark, sf_dir), "boosted_trees", lambda df: positive_weight(df, "target"))


@query("J4 J8")
def deep_boosted_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(matrix(spark, sf_dir), "boosted_trees_deep")


@query("J5 J8")
def logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(matrix(spark, sf_dir), "logistic")


@query("J6 J8")
def neural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(matrix(spark, sf_dir), "neural", maxIter=20)


@query("J6 J8")
def penalised_network_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of 100 rectified units, penalty 0.1, at most 1,000 steps."""
    parts = samples(matrix(spark, sf_dir))
    model = fit_network(parts["train"], S.FEATURES, "target")
    return network_scores(model, stack_samples(parts), ["sample", *KEYS, "target"])


NETWORK_INPUTS = ("web_view", "web_click", "total_view_l7d", "total_click_l7d", "mix_code")
UNITS = (len(NETWORK_INPUTS), 6, 4, 1)


def formula_network() -> Network:
    """Weights by rule, so that SQL can state them too: ((7i + 3j + 2l) mod 9 - 4) / 8, offsets (j mod 3 - 1) / 4."""
    layers = []
    for place, (before, units) in enumerate(zip(UNITS, UNITS[1:])):
        i, j = np.indices((before, units))
        layers.append((((7 * i + 3 * j + 2 * place) % 9 - 4) / 8, (np.arange(units) % 3 - 1) / 4))
    return Network(NETWORK_INPUTS, np.full(UNITS[0], 1.0), np.full(UNITS[0], 2.0), layers)


def _layer(place: int) -> str:
    total = f"sum(v * ((7 * i + 3 * j + 2 * {place}) % 9 - 4) / 8.0) + (j % 3 - 1) / 4.0"
    value = total if place == len(UNITS) - 2 else f"greatest({total}, 0)"
    return (
        f"SELECT account_id, day, target, j AS i, {value} AS v FROM layer_{place} "
        f"CROSS JOIN (SELECT unnest(range({UNITS[place + 1]})) AS j) GROUP BY account_id, day, target, j"
    )


@query(
    "J6 J8",
    given("matrix", more={
        "layer_0": " UNION ALL ".join(
            f"SELECT account_id, day, target, {i} AS i, ({c} - 1) / 2.0::DOUBLE AS v FROM matrix" for i, c in enumerate(NETWORK_INPUTS)
        ),
        **{f"layer_{k + 1}": _layer(k) for k in range(len(UNITS) - 1)},
    })
    + f"SELECT account_id, day, target, CASE WHEN v > 0 THEN 1 ELSE 0 END AS pred, {r6('1 / (1 + exp(-v))')} AS p, "
    f"TRUE AS same_as_expression FROM layer_{len(UNITS) - 1}",
)
def formula_network_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways through a network with given weights."""
    rows = S.activity_matrix(spark, sf_dir)
    network = formula_network()
    share = network_share(network).alias("_share")
    scored = network_scores(network, rows.select(*KEYS, "target", *NETWORK_INPUTS, share), [*KEYS, "target", "_share"])
    same = (F.abs(F.col("p") - F.col("_share")) < 1e-12).alias("same_as_expression")
    return rounded(scored.select(*KEYS, "target", "pred", "p", same), "p")


@query(
    "J8 I4",
    given("matrix")
    + "SELECT account_id, day, target, TRUE AS share_in_range, TRUE AS class_follows_share FROM matrix",
)
def score_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is scored once, shares lie in [0, 1] and the class is the likelier one."""
    rows = matrix(spark, sf_dir)
    scored = score(fit(rows, S.FEATURES, "target", "logistic"), rows, [*KEYS, "target"])
    follows = (F.col("p") > 0.5) == (F.col("pred") == 1)
    return scored.select(
        *KEYS, "target", F.col("p").between(0.0, 1.0).alias("share_in_range"), follows.alias("class_follows_share")
    )


ORDER_FEATURES = ["price", "order_year", "order_month", "priority"]


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        (F.col("o_totalprice") / 1000).alias("price"),
        F.year("o_orderdate").alias("order_year"),
        F.month("o_orderdate").alias("order_month"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


@query("J7")
def class_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pinned(_order_rows(spark, sf_dir))
    models = fit_per_class(rows, ORDER_FEATURES, "o_orderstatus", ["P", "F", "O"], "logistic")
    return score_per_class(models, rows, ["o_orderkey", "o_orderstatus"])


@query("J7 G6")
def class_model_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains table of each class model on its own class."""
    classes = ["P", "F", "O"]
    scored = class_model_scores(spark, sf_dir)
    long = class_scores(scored, ["o_orderkey"], "o_orderstatus", {c: f"score_{c}" for c in classes})
    return gains_table(long, "score", "is_class", ["o_orderkey"], ["class"])


@query("J9")
def features_by_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = samples(matrix(spark, sf_dir))["train"]
    forest = tree_ensemble("importance_forest", "target", seed=1)
    found = backward_elimination(train, S.FEATURES, "target", forest, size=9)
    rows = [(name, found.importance.get(name)) for name in found.kept]
    return spark.createDataFrame(rows, "feature string, importance double")


@query("J10")
def features_by_collinearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped, factors = prune_collinear(S.activity_matrix(spark, sf_dir), S.FEATURES, limit=5.0)
    rows = [(n, factors[n], True) for n in kept] + [(n, v, False) for n, v in dropped]
    return spark.createDataFrame(rows, "feature string, vif double, kept boolean")


@query("J11 J12")
def features_by_genetic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = balanced_weight(samples(matrix(spark, sf_dir))["train"], "target", (0, 1))
    forest = tree_ensemble("balanced_forest", "target", "weight")
    names, found = select_by_genetic_search(
        train, S.FEATURES, "target", KEYS, forest, weight="weight", population=8, generations=1, parallelism=8
    )
    return spark.createDataFrame([(n, found.fitness) for n in names], "feature string, accuracy double")


@query(
    "J13 F12",
    given("scored", more={
        "k": "SELECT unnest([0, 1]) AS v", "s": "SELECT DISTINCT sample FROM scored",
    })
    + "SELECT s.sample, a.v AS actual, b.v AS predicted, count(x.pred) AS n FROM s CROSS JOIN k a CROSS JOIN k b "
    "LEFT JOIN scored x ON x.sample = s.sample AND x.target = a.v AND x.pred = b.v GROUP BY 1, 2, 3",
)
def confusion_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_confusion(S.formula_scores(spark, sf_dir), "target")


# rank sum with mid-ranks for equal scores
AUC = (
    "SELECT sample, (sum(mid) FILTER (WHERE target = 1) - sum(target) * (sum(target) + 1) / 2.0) / "
    "(sum(target) * (count(*) - sum(target))) AS auc FROM (SELECT *, rank() OVER (PARTITION BY sample ORDER BY p) "
    "+ (count(*) OVER (PARTITION BY sample, p) - 1) / 2.0 AS mid FROM scored) GROUP BY 1"
)
REPORT = {
    "k": "SELECT unnest([0, 1]) AS class",
    "hits": "SELECT sample, class, count(*) FILTER (WHERE target = class AND pred = class) AS tp, "
            "count(*) FILTER (WHERE pred = class) AS called, count(*) FILTER (WHERE target = class) AS real "
            "FROM scored CROSS JOIN k GROUP BY 1, 2",
    "macro": "SELECT sample, avg(coalesce(tp / nullif(called, 0), 0)) AS precision, "
             "avg(coalesce(tp / nullif(real, 0), 0)) AS recall, "
             "avg(coalesce(2 * tp / nullif(called + real, 0), 0)) AS f1 FROM hits GROUP BY 1",
    "overall": "SELECT sample, count(*) AS n, avg(CASE WHEN target = pred THEN 1.0 ELSE 0.0 END) AS accuracy "
               "FROM scored GROUP BY 1",
    "ranked": deciles("scored", "sample"),
    "counted": counted("sample"),
    "gains": gains("sample"),
    "ks": "SELECT sample, max(100 * abs(target_running - non_target_running)) AS ks FROM gains GROUP BY 1",
    "auc": AUC,
}
REPORT_SQL = given("scored", more=REPORT) + (
    f"SELECT o.sample, n, {r6('accuracy')} AS accuracy, {r6('precision')} AS precision, {r6('recall')} AS recall, "
    f"{r6('f1')} AS f1, {r6('ks')} AS ks, {r6('auc')} AS auc FROM overall o JOIN macro m ON o.sample = m.sample "
    "JOIN ks ON o.sample = ks.sample JOIN auc ON o.sample = auc.sample"
)


@query("J13 F13 G5", REPORT_SQL)
def formula_report_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sample_report(S.formula_scores(spark, sf_dir), "target", KEYS)
    return rounded(table, "accuracy", "precision", "recall", "f1", "ks", "auc")


@query("J13")
def model_report_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_report(pinned(_scores(matrix(spark, sf_dir), "logistic")), "target", KEYS)


@query("J14")
def families_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = samples(matrix(spark, sf_dir))
    train = parts["train"]
    models = {
        "logistic": fit(train, S.FEATURES, "target", "logistic"),
        "forest": fit(train, S.FEATURES, "target", "importance_forest", seed=1),
        "boosted": fit(train, S.FEATURES, "target", "boosted_trees"),
    }
    return compare_families(models, parts, "target", KEYS)


@query("K1")
def gain_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(samples(matrix(spark, sf_dir))["train"], S.FEATURES, "target", "boosted_trees")
    return X.importance_table(model, S.FEATURES, spark)


@query("K2")
def split_count_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(samples(matrix(spark, sf_dir))["train"], S.FEATURES, "target", "boosted_trees")
    return X.split_counts(X.node_table(model, spark), S.FEATURES)


@query("K3")
def tree_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    model = fit(samples(rows)["train"], S.FEATURES, "target", "boosted_trees")
    return X.tree_contributions(rows, X.node_table(model, spark), S.FEATURES, KEYS)


@query("K3 J8", given("matrix") + "SELECT account_id, day, TRUE AS adds_up FROM matrix")
def tree_contributions_add_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base value and contributions of each row add up to the margin the model itself gives."""
    rows = matrix(spark, sf_dir)
    model = fit(rows, S.FEATURES, "target", "boosted_trees")
    scored = score(model, rows, [*KEYS, *S.FEATURES])
    parts = X.tree_contributions(scored, X.node_table(model, spark), S.FEATURES, KEYS)
    both = parts.join(scored.select(*KEYS, "p"), KEYS)
    share = 1 / (1 + F.exp(-2 * F.col("margin")))
    return both.select(*KEYS, (F.abs(share - F.col("p")) < 1e-9).alias("adds_up"))


POINT_WEIGHTS = {"total_click_l7d": 3.0, "total_view_l3d": 2.0, "mix_code": 1.0, "web_view": 5.0}
LINEAR = ", ".join(f"{w} * ({f} - avg({f}) OVER ()) AS c_{f}" for f, w in POINT_WEIGHTS.items())
BASE = " + ".join(f"{w} * avg({f}) OVER ()" for f, w in POINT_WEIGHTS.items())
POINTS = " + ".join(f"{w} * {f}" for f, w in POINT_WEIGHTS.items())


@query(
    "K3",
    given("matrix", more={"parts": f"SELECT account_id, day, {LINEAR}, {BASE} AS base_value, CAST({POINTS} AS DOUBLE) AS margin FROM matrix"})
    + "SELECT account_id, day, "
    + ", ".join(f"{r6(f'c_{f}')} AS c_{f}" for f in POINT_WEIGHTS)
    + f", {r6('base_value')} AS base_value, {r6('margin')} AS margin FROM parts",
)
def linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.linear_contributions(S.activity_matrix(spark, sf_dir), POINT_WEIGHTS, KEYS)
    return rounded(parts, *[f"c_{f}" for f in POINT_WEIGHTS], "base_value", "margin")


@query(
    "K4",
    given("matrix", more={"parts": f"SELECT {LINEAR} FROM matrix"})
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, {r6(f'avg(abs(c_{f}))')} AS mean_abs FROM parts" for f in POINT_WEIGHTS),
)
def mean_absolute_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.linear_contributions(S.activity_matrix(spark, sf_dir), POINT_WEIGHTS, KEYS)
    return rounded(X.mean_absolute(parts, list(POINT_WEIGHTS)), "mean_abs")


@query(
    "K6 F3",
    given("scored")
    + "SELECT sample, 'predicted' AS kind, pred AS class, count(*) AS n FROM scored GROUP BY 1, 3 UNION ALL "
    "SELECT sample, 'actual', target, count(*) FROM scored GROUP BY 1, 3",
)
def predicted_actual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.formula_scores(spark, sf_dir)
    both = F.array(
        F.struct(F.lit("predicted").alias("kind"), F.col("pred").alias("class")),
        F.struct(F.lit("actual").alias("kind"), F.col("target").alias("class")),
    )
    long = scored.select("sample", F.inline(both))
    return long.groupBy("sample", "kind", "class").agg(F.count(F.lit(1)).alias("n"))


