"""Feature selection by repeated fits.  The driver holds names, masks and scores only."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Binarizer, VectorSlicer
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession

from planshift.functions.fixed_values import GENETIC
from planshift.models.families import assemble
from planshift.operators.sampling import mark_folds
from planshift.session import folder_exists, shared_folder


@dataclass(frozen=True)
class Elimination:
    kept: list[str]
    importance: dict[str, float]  # of the round that chose ``kept``
    rounds: list[tuple[int, list[str]]]  # (features fitted, features dropped)


def backward_elimination(
    df: DataFrame, features: Sequence[str], label: str, estimator: Estimator, size: int, weight: str | None = None
) -> Elimination:
    """Refit and drop every feature tied at the lowest importance until ``size`` or fewer are left.

    A tie can take several features at once, so the result may be smaller than ``size``,
    down to none when all importances are equal.
    """
    shared_folder(df.sparkSession)
    columns = [label, *([weight] if weight else [])]
    vectors = assemble(df, features, "all_features").select("all_features", *columns)
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    kept, importance, rounds = list(features), {}, []
    try:
        while len(kept) > size:
            places = [features.index(name) for name in kept]
            sliced = VectorSlicer(inputCol="all_features", outputCol="features", indices=places)
            fitted = estimator.fit(sliced.transform(vectors))
            found = dict(zip(kept, map(float, fitted.featureImportances.toArray())))
            lowest = min(found.values())
            survivors = [name for name in kept if found[name] > lowest]
            rounds.append((len(kept), [name for name in kept if name not in survivors]))
            kept, importance = survivors, {name: found[name] for name in survivors}
    finally:
        vectors.unpersist()
    ranked = sorted(kept, key=lambda name: (-importance.get(name, 0.0), name)) if rounds else kept
    return Elimination(ranked, importance, rounds)


Mask = tuple[bool, ...]


@dataclass(frozen=True)
class Search:
    mask: Mask
    fitness: float
    generations: int
    evaluated: int
    scores: dict[Mask, float] = field(default_factory=dict)  # of every mask scored


def mask_names(mask: Mask, features: Sequence[str]) -> list[str]:
    return [name for name, chosen in zip(features, mask) if chosen]


def genetic_search(
    width: int,
    fitness: Callable[[list[Mask]], list[float]],
    seed: int = 0,
    max_features: int = GENETIC["max_features"],
    population: int = GENETIC["population"],
    generations: int = GENETIC["generations"],
    crossover: float = GENETIC["crossover"],
    mutation: float = GENETIC["mutation"],
    swap_each: float = GENETIC["swap_each"],
    flip_each: float = GENETIC["flip_each"],
    tournament: int = GENETIC["tournament"],
    patience: int = GENETIC["patience"],
    scored: Mapping[Mask, float] | None = None,
) -> Search:
    """Best mask of at most ``max_features`` features found by selection, crossover and mutation.

    ``fitness`` scores a list of new masks at once; each distinct mask is scored one time, and
    those in ``scored`` not at all.  Empty and too large masks lose against any scored one.
    Of the best masks the one with the fewest, then the earliest features is returned.  The
    draws hang on the seed and the scores alone, so a search that starts again with the
    scores of a broken one takes the same way.
    """
    rng = random.Random(seed)
    known: dict[Mask, float] = dict(scored or {})
    met: set[Mask] = set()

    def grade(masks: list[Mask]) -> list[float]:
        fit = [m for m in dict.fromkeys(masks) if 0 < sum(m) <= max_features]
        met.update(fit)
        new = [m for m in fit if m not in known]
        known.update(zip(new, fitness(new) if new else []))
        return [known[m] if m in met else float("-inf") for m in masks]

    def newcomer() -> Mask:
        chosen = set(rng.sample(range(width), rng.randint(1, min(max_features, width))))
        return tuple(i in chosen for i in range(width))

    herd = [newcomer() for _ in range(population)]
    grades = grade(herd)
    best_grade = max(grades)
    flat = done = 0
    for done in range(1, generations + 1):
        rivals = [rng.sample(range(population), min(tournament, population)) for _ in range(population)]
        chosen = [list(herd[max(group, key=grades.__getitem__)]) for group in rivals]
        for first, second in zip(chosen[::2], chosen[1::2]):
            if rng.random() < crossover:
                for i in range(width):
                    if rng.random() < swap_each:
                        first[i], second[i] = second[i], first[i]
        for mask in chosen:
            if rng.random() < mutation:
                for i in range(width):
                    if rng.random() < flip_each:
                        mask[i] = not mask[i]
        herd = [tuple(m) for m in chosen]
        grades = grade(herd)
        flat = 0 if max(grades) > best_grade else flat + 1
        best_grade = max(best_grade, *grades)
        if flat >= patience:
            break
    scores = {m: known[m] for m in met}
    tied = [m for m, grade in scores.items() if grade == best_grade]
    best = min(tied, key=lambda m: (sum(m), [i for i, on in enumerate(m) if on]))
    return Search(best, best_grade, done, len(met), scores)


MEMO = "mask string, score double"


def recorded_scores(spark: SparkSession, path: str) -> dict[Mask, float]:
    """The scores that ``record_scores`` has written under ``path`` so far."""
    # the folder appears with the first generation written
    if not folder_exists(spark, path):
        return {}
    rows = spark.read.schema(MEMO).parquet(path).collect()  # at most population * generations masks
    return {tuple(c == "1" for c in r["mask"]): r["score"] for r in rows}


def record_scores(spark: SparkSession, path: str, scores: Mapping[Mask, float]) -> None:
    rows = [("".join("01"[on] for on in mask), score) for mask, score in scores.items()]
    spark.createDataFrame(rows, MEMO).coalesce(1).write.mode("append").parquet(path)


def select_by_genetic_search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    estimator: Estimator,
    folds: int = GENETIC["folds"],
    parallelism: int = 4,
    seed: int = 0,
    weight: str | None = None,
    memo: str | None = None,
    **settings,
) -> tuple[list[str], Search]:
    """Genetic search whose fitness is the mean k-fold accuracy of ``estimator`` on the masked features.

    All new masks of a generation go into one cross-validation over one cached frame, with
    ``parallelism`` fits at a time; folds follow the hash of the row keys.  ``weight`` is the
    column that ``estimator`` weighs rows by.  With a ``memo`` path in shared storage the scores
    of each generation are written there, and a search on the same rows and settings that was
    broken off goes on after its last whole generation.
    """
    spark = df.sparkSession
    shared_folder(spark)
    folded = mark_folds(df, keys, folds, seed)
    vectors = assemble(folded, features, "all_features").select("all_features", label, "fold", *([weight] if weight else []))
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    slicer = VectorSlicer(inputCol="all_features", outputCol="features")
    # class of a two-class forest, and of a classifier just as well
    chosen = Binarizer(inputCol="prediction", outputCol="chosen", threshold=0.5)
    accuracy = MulticlassClassificationEvaluator(labelCol=label, predictionCol="chosen", metricName="accuracy")

    def fitness(masks: list[Mask]) -> list[float]:
        grid = [{slicer.indices: [i for i, on in enumerate(m) if on]} for m in masks]
        validator = CrossValidator(
            estimator=Pipeline(stages=[slicer, estimator, chosen]),
            estimatorParamMaps=grid,
            evaluator=accuracy,
            numFolds=folds,
            foldCol="fold",
            parallelism=parallelism,
        )
        found = [float(m) for m in validator.fit(vectors).avgMetrics]
        if memo:
            record_scores(spark, memo, dict(zip(masks, found)))
        return found

    try:
        scored = recorded_scores(spark, memo) if memo else None
        result = genetic_search(len(features), fitness, seed, scored=scored, **settings)
    finally:
        vectors.unpersist()
    return mask_names(result.mask, features), result
