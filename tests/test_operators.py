"""Operators against brute force and their invariants."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planshift.operators import encoding as N
from planshift.operators import gains as G
from planshift.operators import joins as J
from planshift.operators import profile as P
from planshift.operators.activity import trailing_totals
from planshift.operators.collinearity import gram_matrix, inflation_factors, prune_collinear, variance_inflation
from planshift.operators.metrics import class_report, confusion_matrix, macro_metrics
from planshift.operators.ranking import assign_deciles, exact_quantiles, global_rank
from planshift.operators.sampling import balanced_weight, mark_folds, train_test


def qcut_bins(n):
    """Quantile bins of ranks 1..n the way data frames cut them, from the bottom."""
    return pd.qcut(pd.Series(range(1, n + 1)), 10, labels=range(10, 0, -1)).astype(int).tolist()


@pytest.mark.parametrize("n", [11, 15, 23, 100, 257])
def test_deciles_equal_quantile_cut(spark, n):
    rng = random.Random(n)
    rows = [(i, float(rng.randint(0, 4))) for i in range(n)]  # many ties
    df = spark.createDataFrame(rows, "id int, p double").repartition(5)
    found = {r["id"]: r["decile"] for r in assign_deciles(df, "p", ["id"]).collect()}
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert [found[i] for i in order] == qcut_bins(n)
    sizes = pd.Series(list(found.values())).value_counts()
    assert sizes.max() - sizes.min() <= 1


def test_global_rank_in_groups(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 3 else "small", rng.randint(0, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    ranked = global_rank(df, [F.col("v"), F.col("id")], ["g"], pieces=7).toPandas()
    for _, part in ranked.groupby("g"):
        part = part.sort_values(["v", "id"])
        assert part["rank"].tolist() == list(range(1, len(part) + 1))
        assert set(part["total"]) == {len(part)}


def test_rank_of_equal_scores_is_spread_over_tasks(spark):
    """A score shared by all rows still yields pieces of similar size."""
    df = spark.range(10000).withColumn("p", F.lit(0.5))
    from planshift.operators.ranking import _sorted_pieces

    sizes = [r["count"] for r in _sorted_pieces(df, [], [F.col("p"), F.col("id")], 8).groupBy("_piece").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)


@pytest.mark.parametrize("n", [1, 2, 10, 101])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    data = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 3, n).astype(float)})
    df = spark.createDataFrame(data)
    found = exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9, 1.0]).toPandas().set_index("feature")
    for c in ("a", "b"):
        expected = np.quantile(data[c], [0.0, 0.25, 0.5, 0.9, 1.0])
        assert np.allclose(found.loc[c].to_numpy(dtype=float), expected)


def test_profile_matches_describe(spark):
    data = pd.DataFrame({"a": [1.0, 2.0, None, 8.0, 3.5], "b": [None] * 5, "c": [1.0, 1.0, 1.0, 1.0, 1.0]})
    df = spark.createDataFrame(data, "a double, b double, c double")
    found = P.numeric_profile(df, ["a", "b", "c"], "exact").toPandas().set_index("feature")
    described = data.astype(float).describe()
    names = {"n": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%", "q50": "50%", "q75": "75%", "max": "max"}
    for c in "abc":
        for ours, theirs in names.items():
            assert np.allclose(float(found.loc[c, ours]) if found.loc[c, ours] is not None else np.nan,
                               described.loc[theirs, c], equal_nan=True)
    assert found["missing_pct"].to_dict() == {"a": 20.0, "b": 100.0, "c": 0.0}
    sketched = P.numeric_profile(df, ["a"], quantiles="approx").first()
    assert sketched["q50"] in (2.0, 3.5)


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 5, 9.99, 10, 10]], "v double")
    counts = [r["n"] for r in P.histogram(df, "v").orderBy("bin").collect()]
    assert counts == np.histogram([0, 1, 5, 9.99, 10, 10], bins=10)[0].tolist()
    flat = P.histogram(spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double"), "v").orderBy("bin")
    assert [r["n"] for r in flat.collect()] == np.histogram([3.0, 3.0], bins=10)[0].tolist()


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_interval_join_edges_and_forms(spark):
    sales = spark.createDataFrame([(1, day(10), "x"), (2, day(10), "y")], "a int, sale date, s string")
    visits = spark.createDataFrame(
        [(1, day(10), 0), (1, day(8), 2), (1, day(7), 3), (1, day(11), -1), (2, day(9), 1), (3, day(10), 0)],
        "a int, seen date, gap int",
    )
    for form in ("exploded", "bucketed"):
        found = J.join_recent(sales, visits, "a", "sale", "seen", form=form)
        assert sorted((r["a"], r["gap"]) for r in found.collect()) == [(1, 0), (1, 2), (2, 1)]
    last = J.join_recent(sales, visits, "a", "sale", "seen", latest_only=True)
    assert sorted((r["a"], r["gap"]) for r in last.collect()) == [(1, 0), (2, 1)]
    rng = random.Random(4)
    many_sales = spark.createDataFrame([(rng.randint(1, 3), day(rng.randint(0, 60))) for _ in range(80)], "a int, sale date").distinct()
    many_visits = spark.createDataFrame([(rng.randint(1, 3), day(rng.randint(0, 60))) for _ in range(120)], "a int, seen date").distinct()
    for low, high in ((0, 0), (0, 9), (3, 30)):
        pairs = [J.join_recent(many_sales, many_visits, "a", "sale", "seen", low, high, form) for form in ("exploded", "bucketed")]
        assert pairs[0].exceptAll(pairs[1]).count() == pairs[1].exceptAll(pairs[0]).count() == 0
        crossed = [(s, v) for s in many_sales.collect() for v in many_visits.collect() if s["a"] == v["a"]]
        assert pairs[0].count() == sum(low <= (s["sale"] - v["seen"]).days <= high for s, v in crossed)
    strict = J.join_recent(sales, visits, "a", "sale", "seen", low=1)
    assert sorted((r["a"], r["gap"]) for r in strict.collect()) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_exact(spark, how):
    rng = random.Random(2)
    keys = [7 if rng.random() < 0.4 else (None if rng.random() < 0.3 else rng.randint(0, 50)) for _ in range(3000)]
    many = spark.createDataFrame(list(enumerate(keys)), "id int, k int")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(0, 40)], "k int, v string")
    hot = J.hot_values(many, "k", share=0.05)["k"]
    assert 7 in hot and None not in hot
    plain = many.join(one, "k", how)
    spread = J.lookup_join(many, one, ["k"], how, "k", hot)
    assert plain.exceptAll(spread.select(plain.columns)).count() == 0
    assert spread.select(plain.columns).exceptAll(plain).count() == 0


def test_enrichment_ignores_copied_flags(spark):
    base = spark.createDataFrame([(1, day(0)), (2, day(0))], "account_id int, d date")
    flags = spark.createDataFrame([(1, day(0), 1), (1, day(0), 1)], "account_id int, d date, f int")
    found = J.enrich(base, (flags, ["account_id", "d"], []))
    assert sorted((r["account_id"], r["f"]) for r in found.collect()) == [(1, 1), (2, None)]


def reference_woe(data, variable, label, classes):
    events, others = [], []
    known = data[data[variable].notna()]
    for c in classes:
        flag = (known[label] == c).astype(int)
        table = known.groupby([variable, flag]).size().unstack().reindex(columns=[0, 1]).fillna(0)
        shares = (table / table.sum()).fillna(0)
        others.append(shares[0])
        events.append(shares[1])
    e, ne = pd.DataFrame(events).mean(), pd.DataFrame(others).mean()
    woe = np.log((e + 0.001) / (ne + 0.001))
    return pd.DataFrame({"woe": woe, "iv": (e - ne) * woe})


@pytest.mark.parametrize("classes", [[1, 2, 3], [1], [4]])
def test_woe_brute_force(spark, classes):
    rng = np.random.default_rng(0)
    data = pd.DataFrame({
        "v": rng.choice(["a", "b", "c", None], 400), "w": rng.choice(["x", "y"], 400), "target": rng.integers(1, 4, 400),
    })
    data.loc[len(data)] = ["only here", "x", 1]
    df = spark.createDataFrame(data)
    found = N.weight_of_evidence(df, ["v", "w"], "target", classes).toPandas()
    for variable in ("v", "w"):
        ours = found[found.variable == variable].set_index("value").sort_index()
        theirs = reference_woe(data, variable, "target", classes).sort_index()
        assert ours.index.tolist() == theirs.index.tolist()
        assert np.allclose(ours["woe"], theirs["woe"]) and np.allclose(ours["iv"], theirs["iv"])


def test_mirrored_classes_carry_no_evidence(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "v string, t int")
    table = N.weight_of_evidence(df, ["v"], "t", [0, 1]).collect()
    assert all(abs(r["woe"]) < 1e-12 for r in table)


def test_lookup_broadcast_and_shuffled_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"v{i % 40}", None if i % 7 else "z") for i in range(500)], "id int, v string, w string")
    codes = N.label_codes(df, ["v", "w"])
    short = N.apply_label_codes(df, codes, ["v", "w"]).collect()
    monkeypatch.setattr(N, "BROADCAST_BYTES", 0)
    long = N.apply_label_codes(df, codes, ["v", "w"]).collect()
    assert sorted(map(tuple, short)) == sorted(map(tuple, long))
    tidy = sorted({(v or "NA").upper() for v in df.toPandas()["v"]})
    assert {r["v_LE"] for r in short} == set(range(len(tidy)))
    assert all(tidy[r["v_LE"]] == r["v"].upper() for r in short)


def test_value_without_match_is_unknown(spark):
    woe = N.weight_of_evidence(spark.createDataFrame([("a", 1), ("b", 0)], "v string, t int"), ["v"], "t", [1])
    later = spark.createDataFrame([("a",), ("new",), (None,)], "v string")
    found = {r["v"]: r["v_WOE"] for r in N.apply_woe(later, woe, ["v"]).collect()}
    assert found["a"] is not None and found["new"] is None and found[None] is None


def test_inflation_against_regressions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) + 2
    x[:, 3] = x[:, 0] + 0.1 * rng.normal(size=300)
    names = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    expected = []
    for i in range(4):
        others = np.delete(x, i, 1)
        residual = x[:, i] - others @ np.linalg.lstsq(others, x[:, i], rcond=None)[0]
        expected.append(x[:, i] @ x[:, i] / (residual @ residual))
    assert np.allclose(inflation_factors(gram_matrix(df, names)), expected)
    table = {r["feature"]: r["vif"] for r in variance_inflation(df, names).collect()}
    assert np.allclose([table[n] for n in names], expected)


def test_missing_values_add_nothing(spark):
    data = pd.DataFrame({f"x{i}": [1.0, 2.0, None if i % 2 else 3.0] for i in range(8)})
    df = spark.createDataFrame(data)
    names = list(data.columns)
    narrow = gram_matrix(df, names[:4])
    assert np.allclose(gram_matrix(df, names)[:4, :4], narrow) and narrow[1, 1] == 5.0


def test_wide_gram_matrix_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 30))
    names = [f"x{i}" for i in range(30)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(4)
    assert np.allclose(gram_matrix(df, names), x.T @ x)
    centred = x - x.mean(axis=0)
    assert np.allclose(gram_matrix(df, names, centred=True), centred.T @ centred)


def test_pruning_copies_and_constants(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"a": rng.normal(size=100), "b": rng.normal(size=100)})
    data["copy"], data["zero"], data["one"] = data["a"], 0.0, 1.0
    df = spark.createDataFrame(data)
    kept, dropped, factors = prune_collinear(df, ["a", "b", "copy", "zero", "one"])
    assert dropped == [("a", float("inf"))]
    assert kept == ["b", "copy", "zero", "one"] and max(factors.values()) < 10
    assert prune_collinear(df, ["b"])[0] == ["b"]


def test_metrics_without_base_are_zero(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1)], "y int, pred int")
    report = {r["class"]: (r["precision"], r["recall"], r["f1"]) for r in class_report(df, "y", "pred", [0, 1]).collect()}
    assert report[0] == (0.0, 0.0, 0.0) and report[1] == pytest.approx((2 / 3, 1.0, 0.8))
    macro = macro_metrics(df, "y", "pred", [0, 1]).first()
    assert (macro["n"], macro["accuracy"], macro["precision"]) == (3, pytest.approx(2 / 3), pytest.approx(1 / 3))
    cells = confusion_matrix(df, "y", "pred", [0, 1]).collect()
    assert len(cells) == 4 and sum(r["n"] for r in cells) == 3


def test_gains_invariants(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.random(), int(rng.random() < 0.3)) for i in range(777)], "id int, p double, y int")
    table = G.gains_table(df, "p", "y", ["id"]).orderBy("decile").collect()
    assert sum(r["n"] for r in table) == 777
    assert table[-1]["target_running"] == pytest.approx(1) and table[-1]["non_target_running"] == pytest.approx(1)
    ks = G.ks_distance(spark.createDataFrame(table)).first()["ks"]
    upside_down = df.withColumn("p", -F.col("p")).withColumn("id", -F.col("id"))
    flipped = G.ks_distance(G.gains_table(upside_down, "p", "y", ["id"])).first()["ks"]
    # deciles are symmetric up to one row per edge
    assert abs(ks - flipped) < 100 * 10 / 200


def test_area_under_curve_counts_pairs(spark):
    rng = random.Random(8)
    rows = [("g" if i % 4 else "h", rng.randint(0, 6) / 6, int(rng.random() < 0.4)) for i in range(300)]
    found = {r["g"]: r["auc"] for r in G.area_under_curve(spark.createDataFrame(rows, "g string, p double, y int"), "p", "y", ["g"]).collect()}
    for group in ("g", "h"):
        hits = [p for g, p, y in rows if g == group and y]
        others = [p for g, p, y in rows if g == group and not y]
        won = sum((a > b) + 0.5 * (a == b) for a in hits for b in others)
        assert found[group] == pytest.approx(won / len(hits) / len(others))


def test_gains_without_targets(spark):
    df = spark.range(30).select("id", (F.col("id") / 30).alias("p"), F.lit(0).alias("y"))
    table = G.gains_table(df, "p", "y", ["id"]).collect()
    assert len(table) == 10 and all(r["target_share"] is None for r in table)


def test_trailing_totals_skip_missing_days(spark):
    df = spark.createDataFrame([(1, day(0), 5), (1, day(2), 7), (1, day(3), 1)], "k int, d date, m int")
    found = trailing_totals(df, "k", "d", ["m"], [2, 3]).orderBy("d").collect()
    assert [(r["m_l2d"], r["m_l3d"]) for r in found] == [(5, 5), (7, 12), (8, 8)]


def test_split_is_disjoint_and_whole(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    train, test = train_test(df, ["k"])
    assert train.count() + test.count() == 2000 and train.join(test, "k").count() == 0
    assert 0.15 < test.count() / 2000 < 0.25
    folds = {r["fold"]: r["count"] for r in mark_folds(df, ["k"], 3, 1).groupBy("fold").count().collect()}
    assert set(folds) == {0, 1, 2}


def test_balanced_weights_sum_alike(spark):
    df = spark.createDataFrame([(1,)] * 9 + [(0,)] * 1 + [(None,)], "y int")
    sums = {r["y"]: r["s"] for r in balanced_weight(df, "y", (0, 1)).groupBy("y").agg(F.sum("weight").alias("s")).collect()}
    assert sums[0] == pytest.approx(sums[1]) and sums[None] is None
