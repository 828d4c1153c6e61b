"""How often inputs are made, how many rows are shuffled, and that the results stay exact."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planshift.operators import ranking as R
from planshift.operators.gains import area_under_curve, gains_table
from planshift.operators.profile import class_share, missing_text, null_counts, numeric_profile, target_correlation
from planshift.operators.encoding import information_value, weight_of_evidence
from planshift.plans.report import profile_report


def counting(df):
    """``df``, and a counter of the rows that were made of it."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(passed, df.schema), made


def numbers(spark, n=6000):
    draw = random.Random(4)
    rows = [
        (i, draw.gauss(0, 1) if i % 7 else None, float(draw.randrange(3)), 7.0 if draw.random() < 0.4 else draw.random(),
         float("nan") if i % 5 == 0 else draw.randrange(10**9) * 1.0, None, i % 2, f"s{i % 3}")
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double, y int, g string")
    return df.repartition(6), rows


@pytest.mark.parametrize("narrow", [False, True])
def test_bracketed_quantiles_are_exact(spark, monkeypatch, narrow):
    """With brackets of no width most ranks are missed at first, and found by the wider ones."""
    if narrow:
        monkeypatch.setattr(R, "REACHES", (0, 1000, 2000))
        monkeypatch.setattr(R, "bracket_edges", lambda n, e, k, w=0: e[2 * k * w:2 * k * (w + 1)] if e and w < 3 else [float("-inf"), float("inf")])
    df, rows = numbers(spark)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.51, 0.99, 1.0]
    got = {r["feature"]: r for r in R.exact_quantiles(df, list("abcde"), wanted).collect()}
    assert set(got) == set("abcd")
    for i, c in enumerate("abcd", start=1):
        values = np.asarray([r[i] for r in rows if r[i] is not None and not np.isnan(r[i])])
        for p in wanted:
            assert got[c][f"q{round(p * 100):02d}"] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_shuffle_the_brackets_alone(spark, monkeypatch):
    monkeypatch.setattr(R, "SKETCH_PARTS", 1000)
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).cast("double").alias("v")).repartition(4)
    sketch = df.agg(R.edge_sketch(F.col("v"), [0.25, 0.5, 0.75]).alias("e")).first()["e"]
    edges = R.bracket_edges(40_000, sketch, 3)
    counted = R._counted_between(df, {"v": edges}, 3).collect()
    gaps = [r for r in counted if r["value"] is None]
    assert len(gaps) == 4 and sum(r["_n"] for r in counted) == 40_000
    # each bracket holds two parts in a thousand on either side and what the sketch may be wrong by
    assert len(counted) - len(gaps) <= 3 * 6 * 40
    median = R.exact_quantiles(df, ["v"], [0.5]).first()["q50"]
    assert median == np.quantile([i * 7919 % 40_009 for i in range(40_000)], 0.5)


def test_brackets_hold_both_neighbours():
    sketch = list(range(8 * len(R.REACHES)))
    assert R.bracket_edges(10**6, sketch, 2) == [0, 1, 2, 3]
    assert R.bracket_edges(5000, sketch, 2) == [4, 5, 6, 7] and R.bracket_edges(5000, sketch, 2, 1) == [8, 9, 10, 11]
    assert R.bracket_edges(5, sketch, 2) == R.bracket_edges(10**9, None, 2) == [float("-inf"), float("inf")]


def test_brackets_that_touch_run_together():
    apart = R._apart([1.0, 2.0, 2.0, 5.0, 7.0, 7.0], 3)
    assert apart[:2] == [(1.0, 5.0), (7.0, 7.0)] and apart[2][0] > apart[2][1]
    assert R._apart(None, 2) == [(float("inf"), float("-inf"))] * 2


def test_rankings_make_their_input_once(spark):
    df, rows = numbers(spark, 2000)
    counted, made = counting(df)
    assert R.global_rank(counted, [F.col("a"), F.col("id")], ["g"]).count() == len(rows)
    assert made.value == len(rows)
    scored, made = counting(df.select("id", "g", F.col("b").alias("p"), "y"))
    assert len(gains_table(scored, "p", "y", ["id"], ["g"]).collect()) == 30
    assert made.value == len(rows)
    scored, made = counting(df.select("id", F.col("c").alias("p"), "y"))
    area_under_curve(scored, "p", "y").collect()
    assert made.value == len(rows)


def test_report_reads_its_input_once(spark):
    df, rows = numbers(spark, 2000)
    df = df.withColumn("t", F.when(F.col("id") % 11 > 0, F.concat(F.lit("v"), F.col("id") % 4)))
    counted, made = counting(df)
    tables = profile_report(counted, "y", [1], ["id"])
    found = {name: sorted(map(str, t.collect())) for name, t in tables.items()}
    assert made.value == len(rows)
    # the same tables, each by a pass of its own
    texts, values = ["g", "t"], list("abcde")
    evidence = weight_of_evidence(df, texts, "y", [1])
    alone = {
        "class_share": class_share(df, "y").withColumn("n", F.col("n")), "nulls": null_counts(df),
        "correlation": target_correlation(df, values, "y", 0.015), "missing_text": missing_text(df.select(*texts)),
        "evidence": evidence, "information_value": information_value(evidence), "numeric": numeric_profile(df, values),
    }
    assert set(found) == set(alone)
    for name in ("class_share", "nulls", "missing_text"):
        assert found[name] == sorted(map(str, alone[name].select(tables[name].columns).collect())), name
    for name in ("correlation", "evidence", "information_value", "numeric"):
        keys = [c for c in ("feature", "variable", "value") if c in tables[name].columns]
        one, two = (
            {tuple(r[k] for k in keys): [r[c] for c in tables[name].columns if c not in keys] for r in t.collect()}
            for t in (tables[name], alone[name])
        )
        assert set(one) == set(two)
        for key in one:
            for x, y in zip(one[key], two[key], strict=True):
                assert x == y or x == pytest.approx(y, rel=1e-3 if name == "numeric" else 1e-9, nan_ok=True), (name, key)
    counted, made = counting(df)
    exact = profile_report(counted, "y", [1], ["id"], quantiles="exact")["numeric"].collect()
    assert made.value == 2 * len(rows)
    whole = {r["feature"]: r["q50"] for r in R.exact_quantiles(df, values, [0.5]).collect()}
    assert {r["feature"]: r["q50"] for r in exact if r["q50"] is not None} == whole
