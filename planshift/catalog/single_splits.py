"""Fits small enough to be solved in SQL: one tree with one split over the whole matrix.

The best split of a tree is a plain maximum over (feature, threshold), so the same trainers
that grow the full ensembles are checked here value by value, together with importance,
split counts, contributions and elimination on top of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.catalog.modelling import KEYS, matrix
from planshift.catalog.profiles import r6, rounded
from planshift.catalog.registry import query
from planshift.catalog.sql_parts import given
from planshift.models import explain as X
from planshift.models.families import fit, score, tree_ensemble
from planshift.models.selection import backward_elimination
from planshift.operators.collinearity import prune_collinear
from planshift.operators.sampling import positive_weight, train_test
from planshift.sources import standins as S

# few distinct whole numbers each, so every midpoint between two values is a candidate
SPLIT_FEATURES = [
    "web_view", "web_click", "mobile_view", "mobile_click", "total_view_l3d", "total_click_l3d", "mix_code",
]
ONE_SPLIT = {"numTrees": 1, "maxDepth": 1, "featureSubsetStrategy": "all", "bootstrap": False, "seed": 1}


def split_parts(
    weight: str, source: str = "matrix", features=SPLIT_FEATURES, target: str = "target", tag: str = "", least: int = 1
) -> dict[str, str]:
    """Best split of weighted rows; impurity p(1-p) up to a factor.  ``tag`` ends the names of the parts."""

    def spread(n: str, y: str) -> str:
        return f"{n} * ({y} / {n}) * (1 - {y} / {n})"

    parts = {
        "long": " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, {target} AS target FROM {source}" for f in features),
        "per_value": f"SELECT feature, x, count(*) AS k, sum({weight}) AS n, sum({weight} * target) AS y "
                     f"FROM long{tag} GROUP BY 1, 2",
        "sides": "SELECT feature, x, (x + lead(x) OVER f) / 2.0 AS cut, sum(k) OVER f AS left_k, sum(n) OVER f AS left_n, "
                 "sum(y) OVER f AS left_y, sum(n) OVER (PARTITION BY feature) AS n, sum(k) OVER (PARTITION BY feature) AS k, "
                 "sum(y) OVER (PARTITION BY feature) AS y FROM "
                 f"per_value{tag} WINDOW f AS (PARTITION BY feature ORDER BY x)",
        "best": f"SELECT *, left_k / k AS left_share FROM sides{tag} WHERE cut IS NOT NULL AND left_k >= {least} "
                f"AND k - left_k >= {least} ORDER BY "
                f"{spread('left_n', 'left_y')} + {spread('(n - left_n)', '(y - left_y)')}, feature, cut LIMIT 1",
        "leaves": "SELECT feature, cut, left_share, left_y / left_n AS left_p, (y - left_y) / (n - left_n) AS right_p "
                  f"FROM best{tag}",
    }
    return {name + tag: sql for name, sql in parts.items()}


def positive_class(weight: float) -> str:
    return f"CASE WHEN target = 1 THEN {weight}::DOUBLE ELSE 1.0::DOUBLE END"


def balanced(source: str) -> str:
    """Weight n / (2 * rows of the class)."""
    return (
        f"(SELECT count(*) / (2.0::DOUBLE * count(*) FILTER (WHERE target = 1)) FROM {source}) * target + "
        f"(SELECT count(*) / (2.0::DOUBLE * count(*) FILTER (WHERE target = 0)) FROM {source}) * (1 - target)"
    )


def side_of(features) -> str:
    return "CASE feature " + " ".join(f"WHEN '{f}' THEN {f} <= cut" for f in features) + " END"


FOREST = given("matrix", more=split_parts("1.0::DOUBLE"))
BOOSTED = given("matrix", more=split_parts(positive_class(0.647322)))
SIDE = side_of(SPLIT_FEATURES)


def _forest(rows: DataFrame):
    return fit(rows, SPLIT_FEATURES, "target", "importance_forest", **ONE_SPLIT)


def one_round_boosted(rows: DataFrame):
    weighed = positive_weight(rows, "target")
    return fit(weighed, SPLIT_FEATURES, "target", "boosted_trees", weight="weight", maxIter=1, maxDepth=1)


@query(
    "J1 J8",
    FOREST + f"SELECT account_id, day, target, {r6(f'CASE WHEN {SIDE} THEN left_p ELSE right_p END')} AS p, "
    f"CASE WHEN CASE WHEN {SIDE} THEN left_p ELSE right_p END > 0.5 THEN 1 ELSE 0 END AS pred FROM matrix CROSS JOIN leaves",
)
def one_split_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    return rounded(score(_forest(rows), rows, [*KEYS, "target"]), "p")


MARGIN = f"(2 * CASE WHEN {SIDE} THEN left_p ELSE right_p END - 1)"


@query(
    "J3 J8 I5",
    BOOSTED + f"SELECT account_id, day, target, {r6(f'1 / (1 + exp(-2 * {MARGIN}))')} AS p, "
    f"CASE WHEN {MARGIN} > 0 THEN 1 ELSE 0 END AS pred FROM matrix CROSS JOIN leaves",
)
def one_round_boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    return rounded(score(one_round_boosted(rows), rows, [*KEYS, "target"]), "p")


LISTED = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CASE WHEN feature = '{f}' THEN 1 ELSE 0 END AS used FROM leaves" for f in SPLIT_FEATURES
)


@query("K1 J1", FOREST + f"SELECT feature, CAST(used AS DOUBLE) AS importance FROM ({LISTED})")
def one_split_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.importance_table(_forest(matrix(spark, sf_dir)), SPLIT_FEATURES, spark)


@query("K2 J3", BOOSTED + f"SELECT feature, CAST(used AS BIGINT) AS splits FROM ({LISTED})")
def one_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.split_counts(X.node_table(one_round_boosted(matrix(spark, sf_dir)), spark), SPLIT_FEATURES)


@query(
    "K1 K2",
    BOOSTED + f"SELECT feature, {r6('cut')} AS threshold, {r6('2 * left_p - 1')} AS left_value, "
    f"{r6('2 * right_p - 1')} AS right_value, {r6('left_share')} AS left_share FROM leaves",
)
def boosted_root_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = X.node_table(one_round_boosted(matrix(spark, sf_dir)), spark)
    names = F.array(*[F.lit(f) for f in SPLIT_FEATURES])
    # three nodes: the root is 0, its children follow
    at = {n: nodes.filter(F.col("node") == n) for n in (0, 1, 2)}
    left, right = at[1].select("value").scalar(), at[2].select("value").scalar()
    table = at[0].select(
        F.element_at(names, F.col("feature_index") + 1).alias("feature"),
        "threshold",
        left.alias("left_value"),
        right.alias("right_value"),
        (at[1].select("cover").scalar() / F.col("cover")).alias("left_share"),
    )
    return rounded(table, "threshold", "left_value", "right_value", "left_share")


PARTS = {
    **split_parts(positive_class(0.647322)),
    "parts": f"SELECT account_id, day, feature, {MARGIN} AS margin, "
             "left_share * (2 * left_p - 1) + (1 - left_share) * (2 * right_p - 1) AS base_value FROM matrix CROSS JOIN leaves",
}


@query(
    "K3",
    given("matrix", more=PARTS)
    + "SELECT account_id, day, "
    + ", ".join(f"CASE WHEN feature = '{f}' THEN {r6('margin - base_value')} ELSE 0.0::DOUBLE END AS c_{f}" for f in SPLIT_FEATURES)
    + f", {r6('base_value')} AS base_value, {r6('margin')} AS margin FROM parts",
)
def one_split_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    parts = X.tree_contributions(rows, X.node_table(one_round_boosted(rows), spark), SPLIT_FEATURES, KEYS)
    return rounded(parts, *[f"c_{f}" for f in SPLIT_FEATURES], "base_value", "margin")


@query(
    "K4",
    given("matrix", more={**PARTS, "mean": "SELECT feature, avg(abs(margin - base_value)) AS m FROM parts GROUP BY 1"})
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN feature = '{f}' THEN {r6('m')} ELSE 0.0::DOUBLE END AS mean_abs FROM mean" for f in SPLIT_FEATURES),
)
def one_split_mean_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    parts = X.tree_contributions(rows, X.node_table(one_round_boosted(rows), spark), SPLIT_FEATURES, KEYS)
    return rounded(X.mean_absolute(parts, SPLIT_FEATURES), "mean_abs")


@query("J9", FOREST + "SELECT feature, 1.0::DOUBLE AS importance FROM leaves")
def elimination_to_one_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features without a split tie at importance 0 and leave in the first round."""
    forest = tree_ensemble("importance_forest", "target", **ONE_SPLIT)
    found = backward_elimination(matrix(spark, sf_dir), SPLIT_FEATURES, "target", forest, size=3)
    rows = [(name, found.importance[name]) for name in found.kept]
    return spark.createDataFrame(rows, "feature string, importance double")


LOGISTIC_FEATURES = ["web_view", "web_click", "total_click_l7d", "tenure", "mix_code"]


@query("J5", "SELECT unnest([" + ", ".join(f"'{f}'" for f in LOGISTIC_FEATURES) + "]) AS feature, TRUE AS at_optimum")
def logistic_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the fitted weights, loss and penalty pull equally hard on each feature."""
    rows = matrix(spark, sf_dir)
    model = fit(rows, LOGISTIC_FEATURES, "target", "logistic", tol=1e-8, maxIter=200)
    weights = model.stages[-1].coefficients.toArray()
    scored = score(model, rows, [*LOGISTIC_FEATURES, "target"])
    off = F.col("p") - F.col("target")
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            (F.abs(F.sum(off * F.col(f)) + float(w)) < 1e-4 * F.sum(F.abs(F.col(f)))).alias("at_optimum"),
        )
        for f, w in zip(LOGISTIC_FEATURES, weights)
    ]
    return scored.agg(F.array(*entries).alias("_rows")).select(F.inline("_rows"))


HASH = "('0x' || substr(md5(account_id || '|' || strftime(day, '%Y-%m-%d') || '|3'), 1, 8))::BIGINT / 4294967296.0"


@query(
    "I3 I4 J8",
    given("matrix")
    + f"SELECT account_id, day, CASE WHEN {HASH} < 0.2 THEN 'test' ELSE 'train' END AS sample, target, "
    "TRUE AS share_in_range FROM matrix WHERE sample = 'dev'",
)
def training_sides_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the split come back whole and scored."""
    dev = matrix(spark, sf_dir).filter(F.col("sample") == "dev").drop("sample")
    train, test = train_test(dev, KEYS)
    model = fit(train, S.FEATURES, "target", "logistic")
    both = train.withColumn("sample", F.lit("train")).unionByName(test.withColumn("sample", F.lit("test")))
    scored = score(model, both, [*KEYS, "sample", "target"])
    return scored.select(*KEYS, "sample", "target", F.col("p").between(0.0, 1.0).alias("share_in_range"))


LINES = ("l_quantity", "l_extendedprice", "l_discount")
A, B, C = LINES
PRUNE = {
    "g": "SELECT " + ", ".join(f"sum({x} * {y}) AS {n}" for n, x, y in (
        ("aa", A, A), ("bb", B, B), ("cc", C, C), ("ab", A, B), ("ac", A, C), ("bc", B, C))) + " FROM lineitem",
    "d": "SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM g",
    "three": f"SELECT '{A}' AS feature, aa * (bb * cc - bc * bc) / det AS vif, bb * cc / (bb * cc - bc * bc) AS rest FROM d "
             f"UNION ALL SELECT '{B}', bb * (aa * cc - ac * ac) / det, aa * cc / (aa * cc - ac * ac) FROM d "
             f"UNION ALL SELECT '{C}', cc * (aa * bb - ab * ab) / det, aa * bb / (aa * bb - ab * ab) FROM d",
    # first the worst of three, then, if the other two still go together, the first of them by name
    "worst": "SELECT feature, vif, rest FROM three ORDER BY vif DESC LIMIT 1",
}
PRUNE_LIMIT = 2.0


@query(
    "J10 F15",
    given(more={
        **PRUNE,
        "left_two": "SELECT feature, row_number() OVER (ORDER BY feature) AS place FROM three "
                    "WHERE feature <> (SELECT feature FROM worst)",
    })
    + f"SELECT w.feature, FALSE AS kept, {r6('w.vif')} AS vif FROM worst w WHERE w.vif >= {PRUNE_LIMIT} UNION ALL "
    f"SELECT l.feature, NOT (place = 1 AND w.rest >= {PRUNE_LIMIT}), "
    f"CASE WHEN w.rest < {PRUNE_LIMIT} OR place = 1 THEN {r6('w.rest')} ELSE 1.0 END FROM left_two l CROSS JOIN worst w",
)
def pruning_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped, factors = prune_collinear(S.table(spark, sf_dir, "lineitem"), LINES, limit=PRUNE_LIMIT)
    rows = [(n, True, factors[n]) for n in kept] + [(n, False, v) for n, v in dropped]
    return rounded(spark.createDataFrame(rows, "feature string, kept boolean, vif double"), "vif")
