"""The penalised network: gradients, fit and scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planshift.models import network as N
from planshift.models.network import fit_network, network_scores, network_share

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = pd.DataFrame(rng.normal(size=(500, 3)), columns=FEATURES)
    x["b"] = 100 + 20 * x["b"]
    # not linear: only the signs of both together tell
    x["y"] = ((x.a * (x.b - 100) > 0) ^ (rng.random(500) < 0.05)).astype(int)
    x["id"] = range(500)
    return x


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(4, "id").cache()


def layers_of(rng, sizes):
    return [(rng.normal(size=(a, b)), rng.normal(size=b)) for a, b in zip(sizes, sizes[1:])]


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    sizes = [3, 4, 2, 1]
    layers = layers_of(rng, sizes)
    x, y, w = rng.normal(size=(20, 3)), rng.integers(0, 2, 20), rng.random(20)
    flat = N._flat(layers)
    found = N.loss_and_gradient(layers, x, y, w)
    assert found[0] == pytest.approx(w.sum())
    network = N.Network(tuple(FEATURES), np.zeros(3), np.ones(3), layers)
    p = network.share(x)
    assert found[1] == pytest.approx(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-6
        up, down = (N.loss_and_gradient(N._cut(flat + s, sizes), x, y, w)[1] for s in (step, -step))
        assert found[2 + i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_steps_reach_the_least_of_a_bowl():
    draw = np.random.default_rng(1)
    half = draw.normal(size=(12, 12))
    bowl, goal = half @ half.T + np.eye(12), draw.normal(size=12)
    found, losses = N.descend(lambda v: (0.5 * (v - goal) @ bowl @ (v - goal), bowl @ (v - goal)), np.zeros(12), 200, 1e-14)
    assert np.allclose(found, goal, atol=1e-4) and losses == sorted(losses, reverse=True)


def test_network_learns_what_no_line_can(df, data):
    network = fit_network(df, FEATURES, "y", hidden=(16, 16), max_iter=60)
    assert list(network.losses) == sorted(network.losses, reverse=True)
    scored = network_scores(network, df, ["id", "y"])
    assert scored.columns == ["id", "y", "pred", "p"] and scored.count() == 500
    assert scored.filter("pred = y").count() > 450
    both = network_scores(network, df.select("*", network_share(network).alias("q")), ["id", "q"])
    assert both.filter(F.abs(F.col("p") - F.col("q")) > 1e-12).count() == 0
    held = both.toPandas().set_index("id").sort_index()["p"]
    assert np.allclose(held, network.share(data[FEATURES].to_numpy()))


def test_penalty_takes_weights_down_and_partial_sums_in_groups_agree(df, monkeypatch):
    def size(network):
        return sum((w**2).sum() for w, _ in network.layers)

    free, held = (fit_network(df, FEATURES, "y", hidden=(8,), max_iter=15, penalty=p) for p in (0.0, 20.0))
    assert size(held) < 0.5 * size(free)
    monkeypatch.setattr(N, "MOST_PARTS", 1)
    grouped = fit_network(df, FEATURES, "y", hidden=(8,), max_iter=15, penalty=20.0)
    assert grouped.losses == pytest.approx(held.losses)


def test_row_weights_count_like_copies(df):
    twice = df.withColumn("w", F.when(F.col("id") < 100, 2.0).otherwise(1.0))
    copied = df.union(df.filter("id < 100"))
    flat = [fit_network(d, FEATURES, "y", hidden=(4,), max_iter=1, weight=w).losses[0] for d, w in ((twice, "w"), (copied, None))]
    # moments differ a little, as they do not weigh rows
    assert flat[0] == pytest.approx(flat[1], rel=0.05)


def test_missing_constant_and_empty_inputs(spark, df):
    with pytest.raises(Exception, match="missing"):
        fit_network(df.withColumn("a", F.when(F.col("id") > 5, F.col("a"))), FEATURES, "y", hidden=(2,), max_iter=1)
    with pytest.raises(ValueError, match="no rows"):
        fit_network(df.limit(0), FEATURES, "y", hidden=(2,), max_iter=1)
    flat = fit_network(df.withColumn("c", F.lit(3.0)), FEATURES, "y", hidden=(2,), max_iter=2)
    assert np.isfinite(flat.losses).all()
    none = network_scores(flat, df.limit(0), ["id"])
    assert none.columns == ["id", "pred", "p"] and none.count() == 0
