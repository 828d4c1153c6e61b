"""The histogram trainer against Spark's own, on rows made here."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from planshift.models import boosting
from planshift.models.boosting import BoostedTrees, cut_points
from planshift.models.families import assemble

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame(rng.normal(size=(900, 3)), columns=FEATURES)
    x["c"] = x["c"].round().clip(-2, 2)
    x["y"] = ((x.a - 0.7 * x.b + 0.4 * x.c + 0.5 * rng.normal(size=900)) > 0.2).astype(int)
    x["w"] = np.where(x.y == 1, 0.65, 1.0)
    return assemble(spark.createDataFrame(x), FEATURES).repartition(3).cache()


@pytest.mark.parametrize("settings", [
    {"maxIter": 8, "maxDepth": 3, "stepSize": 0.1},
    {"maxIter": 3, "maxDepth": 4, "stepSize": 0.3, "weightCol": "w", "minInstancesPerNode": 20},
])
def test_same_model_as_sparks_trainer_in_fewer_jobs(rows, monkeypatch, settings):
    jobs, measure = [], boosting._Rows.measure

    def counted(self, *args):
        jobs.append(len(self.trees))
        return measure(self, *args)

    monkeypatch.setattr(boosting._Rows, "measure", counted)
    monkeypatch.setattr(boosting, "ROUNDS_PER_STATE", 3)
    mine, theirs = (kind(labelCol="y", **settings).fit(rows) for kind in (BoostedTrees, GBTClassifier))
    most = settings["maxIter"] * settings["maxDepth"]
    # trees that differ much leave nothing to guess
    assert len(jobs) < most if settings["stepSize"] < 0.2 else len(jobs) <= most
    assert mine.treeWeights == theirs.treeWeights and mine.numFeatures == theirs.numFeatures == 3
    assert [t.numNodes for t in mine.trees] == [t.numNodes for t in theirs.trees]
    assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)
    raw = F.col("rawPrediction")
    left, right = (np.array([r[0][1] for r in m.transform(rows.orderBy(*FEATURES)).select(raw).collect()]) for m in (mine, theirs))
    assert np.allclose(left, right, atol=1e-9)


def test_labels_other_than_0_and_1_are_an_error(rows):
    with pytest.raises(ValueError, match="labels"):
        BoostedTrees(labelCol="y", maxIter=1).fit(rows.withColumn("y", F.col("y") + 1))


def test_cut_points():
    assert cut_points(np.array([1.0, 2, 4]), np.ones(3), 5).tolist() == [1.5, 3.0]
    assert len(cut_points(np.arange(100.0), np.ones(100), 31)) == 31
    assert cut_points(np.array([7.0]), np.ones(1), 31).tolist() == []
