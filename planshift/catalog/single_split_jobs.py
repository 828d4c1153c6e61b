"""Weighted fits, per-class fits and the modelling jobs with one-split trees, solved in SQL value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.catalog.modelling import KEYS, REPORT, SAMPLES, matrix, samples
from planshift.catalog.profiles import r6, rounded
from planshift.catalog.rankings import LIFT_SQL, SHARE_COLUMNS, SHARES_SQL
from planshift.catalog.registry import query
from planshift.catalog.single_splits import (
    HASH,
    LINES,
    LISTED,
    MARGIN,
    ONE_SPLIT,
    PARTS as BOOSTED_PARTS,
    PRUNE,
    PRUNE_LIMIT,
    SIDE,
    SPLIT_FEATURES,
    balanced,
    one_round_boosted,
    side_of,
    split_parts,
)
from planshift.catalog.sql_parts import given
from planshift.models.evaluation import compare_families
from planshift.models.families import fit, fit_per_class, score, score_per_class, tree_ensemble
from planshift.models.selection import mask_names, select_by_genetic_search
from planshift.operators.sampling import balanced_weight
from planshift.plans.explanation import explain
from planshift.plans.selection import select_features
from planshift.plans.training import score_and_evaluate, train
from planshift.session import work_path
from planshift.sources import standins as S

LEAF = f"CASE WHEN {SIDE} THEN left_p ELSE right_p END"


@query(
    "J2 I5 J8",
    given("matrix", more=split_parts(balanced("matrix")))
    + f"SELECT account_id, day, target, {r6(LEAF)} AS p, CASE WHEN {LEAF} > 0.5 THEN 1 ELSE 0 END AS pred "
    "FROM matrix CROSS JOIN leaves",
)
def one_split_balanced_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    weighed = balanced_weight(rows, "target", (0, 1))
    model = fit(weighed, SPLIT_FEATURES, "target", "balanced_forest", weight="weight", **ONE_SPLIT)
    return rounded(score(model, rows, [*KEYS, "target"]), "p")


@query(
    "J4 J8",
    given("matrix", more=split_parts("1.0::DOUBLE", least=2))
    + f"SELECT account_id, day, target, {r6(f'1 / (1 + exp(-2 * {MARGIN}))')} AS p, "
    f"CASE WHEN {MARGIN} > 0 THEN 1 ELSE 0 END AS pred FROM matrix CROSS JOIN leaves",
)
def one_round_deep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    model = fit(rows, SPLIT_FEATURES, "target", "boosted_trees_deep", maxIter=1, maxDepth=1)
    return rounded(score(model, rows, [*KEYS, "target"]), "p")


ORDER_PARTS = ["order_year", "order_month", "priority"]
STATUSES = ("P", "F", "O")


@query(
    "J7 J8",
    given(more={
        "parts": "SELECT o_orderkey, o_orderstatus, year(o_orderdate) AS order_year, month(o_orderdate) AS order_month, "
                 "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM orders",
        **{
            name: sql for c in STATUSES
            for name, sql in split_parts(
                "1.0::DOUBLE", "parts", ORDER_PARTS, f"CASE WHEN o_orderstatus = '{c}' THEN 1 ELSE 0 END", f"_{c}"
            ).items()
        },
    })
    + "SELECT o_orderkey, o_orderstatus, "
    + ", ".join(
        r6(f"CASE WHEN {side_of(ORDER_PARTS).replace('feature', f'l{c}.feature').replace('cut', f'l{c}.cut')} "
           f"THEN l{c}.left_p ELSE l{c}.right_p END") + f" AS score_{c}"
        for c in STATUSES
    )
    + " FROM parts " + " ".join(f"CROSS JOIN leaves_{c} l{c}" for c in STATUSES),
)
def one_split_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per class, this class against the rest."""
    rows = S.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.year("o_orderdate").alias("order_year"),
        F.month("o_orderdate").alias("order_month"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )
    models = fit_per_class(rows, ORDER_PARTS, "o_orderstatus", STATUSES, "importance_forest", **ONE_SPLIT)
    scored = score_per_class(models, rows, ["o_orderkey", "o_orderstatus"])
    return rounded(scored, *[f"score_{c}" for c in STATUSES])


SIDES = {
    "sided": f"SELECT * REPLACE (CASE WHEN sample <> 'dev' THEN sample WHEN {HASH} < 0.2 THEN 'test' ELSE 'train' END "
             "AS sample) FROM matrix",
    "train_side": "SELECT * FROM sided WHERE sample = 'train'",
}
SCORED = f"SELECT account_id, day, sample, target, p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred FROM (SELECT *, {LEAF} AS p FROM sided CROSS JOIN leaves{{tag}})"
TRAINED = {**SIDES, **split_parts(balanced("train_side"), "train_side"), "scored": SCORED.format(tag="")}


def _trained(spark: SparkSession, sf_dir: str):
    """The training job on the development rows, and all samples."""
    rows = matrix(spark, sf_dir)
    dev = rows.filter(F.col("sample") == "dev").drop("sample")
    # the family's own seed is the same; ``seed`` is that of the split here
    settings = {k: v for k, v in ONE_SPLIT.items() if k != "seed"}
    done = train(dev, SPLIT_FEATURES, "target", KEYS, "balanced_forest", **settings)
    later = {n: rows.filter(F.col("sample") == n).drop("sample") for n in SAMPLES[1:]}
    return done.model, {"train": done.train, "test": done.test, **later}


@query(
    "N6 N7 I3 I4 I5 J8",
    given("matrix", more=TRAINED) + f"SELECT account_id, day, sample, target, {r6('p')} AS p, pred FROM scored",
)
def one_split_training_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, sides = _trained(spark, sf_dir)
    return rounded(score_and_evaluate(model, sides, "target", KEYS)["scores"], "p")


METRICS = ("accuracy", "precision", "recall", "f1", "ks", "auc")
METRICS_SQL = ", ".join(f"{r6(m)} AS {m}" for m in METRICS)
REPORTED = (
    "FROM overall o JOIN macro m ON o.sample = m.sample JOIN ks ON o.sample = ks.sample JOIN auc ON o.sample = auc.sample"
)


@query("N7 J13 F13 G5", given("matrix", more={**TRAINED, **REPORT}) + f"SELECT o.sample, n, {METRICS_SQL} {REPORTED}")
def one_split_evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, sides = _trained(spark, sf_dir)
    return rounded(score_and_evaluate(model, sides, "target", KEYS)["report"], *METRICS)


@query(
    "N7 G6",
    given("matrix", more={**TRAINED, **REPORT})
    + f"SELECT sample, decile, n, targets, non_targets, {r6('score_sum')} AS score_sum, {SHARES_SQL}, {LIFT_SQL} FROM gains",
)
def one_split_evaluation_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, sides = _trained(spark, sf_dir)
    table = score_and_evaluate(model, sides, "target", KEYS)["gains"]
    return rounded(table, "score_sum", *SHARE_COLUMNS, "lift", "ks_at")


COMPARED = {
    **SIDES,
    **split_parts("1.0::DOUBLE", "train_side", tag="_plain"),
    **split_parts(balanced("train_side"), "train_side", tag="_balanced"),
    "scored": " UNION ALL ".join(
        f"SELECT * REPLACE ('{f}|' || sample AS sample) FROM ({SCORED.format(tag=f'_{f}')})" for f in ("plain", "balanced")
    ),
    **REPORT,
}


@query(
    "J14 J13",
    given("matrix", more=COMPARED)
    + f"SELECT split_part(o.sample, '|', 1) AS family, split_part(o.sample, '|', 2) AS sample, n, {METRICS_SQL} {REPORTED}",
)
def one_split_families_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = samples(matrix(spark, sf_dir))
    weighed = balanced_weight(parts["train"], "target", (0, 1))
    models = {
        "plain": fit(parts["train"], SPLIT_FEATURES, "target", "importance_forest", **ONE_SPLIT),
        "balanced": fit(weighed, SPLIT_FEATURES, "target", "balanced_forest", weight="weight", **ONE_SPLIT),
    }
    return rounded(compare_families(models, parts, "target", KEYS), *METRICS)


MASKED = ("web_view", "web_click", "total_view_l3d", "mix_code")
# the first population already holds every mask of four features with this seed
SEARCH = {"folds": 3, "seed": 2, "max_features": len(MASKED)}
EVERY_MASK = range(1, 1 << len(MASKED))
SPREAD = "n_l * (y_l / n_l) * (1 - y_l / n_l) + (n - n_l) * ((y - y_l) / (n - n_l)) * (1 - (y - y_l) / (n - n_l))"
MASK_PARTS = {
    "folded": f"SELECT *, CAST(floor({HASH.replace('|3', '|2')} * 3) AS INTEGER) AS fold, {balanced('matrix')} AS w FROM matrix",
    "g_long": " UNION ALL ".join(
        f"SELECT account_id, day, '{f}' AS feature, {i} AS place, {f} AS x, target, w, fold FROM folded"
        for i, f in enumerate(MASKED)
    ),
    "held": "SELECT unnest([0, 1, 2]) AS held",
    "g_values": "SELECT held, feature, place, x, sum(w) AS n, sum(w * target) AS y FROM g_long JOIN held ON fold <> held "
                "GROUP BY 1, 2, 3, 4",
    "g_sides": "SELECT held, feature, place, (x + lead(x) OVER f) / 2.0 AS cut, sum(n) OVER f AS n_l, sum(y) OVER f AS y_l, "
               "sum(n) OVER (PARTITION BY held, feature) AS n, sum(y) OVER (PARTITION BY held, feature) AS y "
               "FROM g_values WINDOW f AS (PARTITION BY held, feature ORDER BY x)",
    "g_masks": " UNION ALL ".join(
        f"SELECT {m} AS mask, '{','.join(f for i, f in enumerate(MASKED) if m >> i & 1)}' AS features, {m.bit_count()} AS size, "
        f"'{''.join(str(i) for i in range(len(MASKED)) if m >> i & 1)}' AS places"
        for m in EVERY_MASK
    ),
    "g_best": "SELECT mask, held, feature, cut, y_l / n_l AS left_p, (y - y_l) / (n - n_l) AS right_p FROM g_sides "
              "JOIN g_masks ON contains(places, CAST(place AS VARCHAR)) WHERE cut IS NOT NULL "
              f"QUALIFY row_number() OVER (PARTITION BY mask, held ORDER BY {SPREAD}, place, cut) = 1",
    "g_folds": "SELECT mask, held, avg(CASE WHEN (CASE WHEN x <= cut THEN left_p ELSE right_p END > 0.5) = (target = 1) "
               "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM g_long l JOIN g_best b "
               "ON l.feature = b.feature AND l.fold = b.held GROUP BY 1, 2",
    "g_scores": "SELECT mask, features, size, places, avg(accuracy) AS accuracy FROM g_folds JOIN g_masks USING (mask) "
                "GROUP BY 1, 2, 3, 4",
    "g_chosen": "SELECT features FROM g_scores ORDER BY round(accuracy, 12) DESC, size, places LIMIT 1",
}


@query(
    "J11 J12",
    given("matrix", more=MASK_PARTS)
    + f"SELECT features, {r6('accuracy')} AS accuracy, features = (SELECT features FROM g_chosen) AS chosen FROM g_scores",
)
def one_split_genetic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mask the search has scored, by the names it stands for, and the one it chose.

    Population, generations, rates, folds and patience are the full ones; the forest is one split.
    """
    rows = balanced_weight(matrix(spark, sf_dir), "target", (0, 1))
    forest = tree_ensemble("balanced_forest", "target", "weight", **ONE_SPLIT)
    chosen, found = select_by_genetic_search(
        rows, MASKED, "target", KEYS, forest, weight="weight", parallelism=8, memo=work_path(spark, "masks"), **SEARCH
    )
    table = [
        (",".join(mask_names(mask, MASKED)), score, mask_names(mask, MASKED) == chosen)
        for mask, score in found.scores.items()
    ]
    return rounded(spark.createDataFrame(table, "features string, accuracy double, chosen boolean"), "accuracy")


TOP = 2
EVIDENCE_OF = {
    "i_cells": " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f} AS x, count(*) FILTER (WHERE target = 1) AS e, "
        f"count(*) FILTER (WHERE target = 0) AS ne FROM matrix GROUP BY 2"
        for f in SPLIT_FEATURES
    ),
    "i_shares": "SELECT feature, e / sum(e) OVER (PARTITION BY feature) AS e, ne / sum(ne) OVER (PARTITION BY feature) AS ne "
                "FROM i_cells",
    "i_best": "SELECT feature FROM i_shares GROUP BY 1 ORDER BY sum((e - ne) * ln((e + 0.001) / (ne + 0.001))) DESC, 1 "
              f"LIMIT {TOP}",
}


@query(
    "N5 J9 J10 J11 J12 F11",
    given("matrix", more={
        **split_parts("1.0::DOUBLE"), **PRUNE, **MASK_PARTS, **EVIDENCE_OF,
        "left_two": "SELECT feature, row_number() OVER (ORDER BY feature) AS place FROM three "
                    "WHERE feature <> (SELECT feature FROM worst)",
    })
    + "SELECT 'importance' AS method, feature FROM leaves UNION ALL SELECT 'information', feature FROM i_best "
    "UNION ALL SELECT 'genetic', unnest(string_split(features, ',')) FROM g_chosen "
    f"UNION ALL SELECT 'collinearity', feature FROM worst WHERE vif < {PRUNE_LIMIT} "
    f"UNION ALL SELECT 'collinearity', l.feature FROM left_two l CROSS JOIN worst w WHERE NOT (place = 1 AND w.rest >= {PRUNE_LIMIT})",
)
def features_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the selection job keeps by each of its methods."""
    lines, rows = S.table(spark, sf_dir, "lineitem"), matrix(spark, sf_dir)
    chosen = {
        "importance": select_features(rows, SPLIT_FEATURES, "target", "importance", size=3, **ONE_SPLIT),
        "information": select_features(rows, SPLIT_FEATURES, "target", "information", top=TOP),
        "genetic": select_features(rows, MASKED, "target", "genetic", KEYS, forest=ONE_SPLIT, parallelism=8, **SEARCH),
        "collinearity": select_features(lines, LINES, "", "collinearity", limit=PRUNE_LIMIT),
    }
    found = [(method, name) for method, names in chosen.items() for name in names]
    return spark.createDataFrame(found, "method string, feature string")


@query(
    "N8 K1 K2 K3 K4",
    given("matrix", more={
        **BOOSTED_PARTS, "listed": LISTED, "mean": "SELECT feature, avg(abs(margin - base_value)) AS m FROM parts GROUP BY 1",
    })
    + "SELECT l.feature, CAST(used AS DOUBLE) AS importance, CAST(used AS BIGINT) AS splits, "
    f"CASE WHEN used = 1 THEN {r6('m')} ELSE 0.0::DOUBLE END AS mean_abs FROM listed l CROSS JOIN mean",
)
def one_split_explanation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    tables = explain(one_round_boosted(rows), rows, SPLIT_FEATURES, KEYS)
    joined = tables["importance"].join(tables["split_counts"], "feature").join(tables["mean_absolute"], "feature")
    return rounded(joined, "mean_abs")
