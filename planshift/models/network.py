"""A two-class network of rectified units with a penalty on its weights.

Spark's own network has sigmoid units and no penalty.  Here tasks turn their rows into one
partial gradient each, Spark sums these, and the driver takes quasi-Newton steps: it holds
the weights and a few past steps, never rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from planshift.functions.fixed_values import NEURAL_BATCH, NEURAL_HIDDEN, NEURAL_MAX_ITER, NEURAL_PENALTY

# so many partial gradients go to the driver at once; more are summed in tasks before
MOST_PARTS = 64
# rows that a task multiplies at a time
SLICE = 4096
# past steps that shape the next one
PAST = 10

Layers = list[tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Network:
    features: tuple[str, ...]
    means: np.ndarray
    scales: np.ndarray
    layers: Layers  # (inputs x units, units) of each layer, the last with one unit
    losses: tuple[float, ...] = ()  # penalised mean loss at the start and after each step

    def share(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row of ``x``."""
        values = (x - self.means) / self.scales
        for weights, bias in self.layers[:-1]:
            values = np.maximum(values @ weights + bias, 0)
        weights, bias = self.layers[-1]
        return _logistic((values @ weights + bias)[:, 0])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    if any(c.null_count for c in columns):
        raise ValueError("a feature, label or weight is missing")
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])


def _cut(flat: np.ndarray, sizes: Sequence[int]) -> Layers:
    layers, at = [], 0
    for before, units in zip(sizes, sizes[1:]):
        weights = flat[at : at + before * units].reshape(before, units)
        at += before * units
        layers.append((weights, flat[at : at + units]))
        at += units
    return layers


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([np.append(w.ravel(), b) for w, b in layers])


def loss_and_gradient(layers: Layers, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted sums over rows: row weight, log loss, then its gradient in the order of ``_flat``."""
    inputs = [x]
    for w, b in layers[:-1]:
        inputs.append(np.maximum(inputs[-1] @ w + b, 0))
    w, b = layers[-1]
    z = (inputs[-1] @ w + b)[:, 0]
    loss = np.logaddexp(0, z) - y * z
    back = ((_logistic(z) - y) * weight)[:, None]
    parts: Layers = []
    for (w, _), values in zip(reversed(layers), reversed(inputs)):
        parts.append((values.T @ back, back.sum(axis=0)))
        back = (back @ w.T) * (values > 0)
    return np.concatenate([[weight.sum(), (loss * weight).sum()], _flat(parts[::-1])])


def summed(parts: DataFrame, count: int) -> np.ndarray:
    """Sum of the ``part`` vectors; beyond ``MOST_PARTS`` of them tasks add them up in groups first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                vector = np.frombuffer(value.as_py())
                total = vector.copy() if total is None else total + vector
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["part"])

    if count > MOST_PARTS:
        parts = parts.repartition(math.isqrt(count)).mapInArrow(add, "part binary")
    return np.sum([np.frombuffer(r["part"]) for r in parts.collect()], axis=0)


def descend(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int, tol: float, patience: int = 10
) -> tuple[np.ndarray, list[float]]:
    """Limited-memory quasi-Newton steps with halved step lengths.

    Ends after ``max_iter`` steps, after ``patience`` steps in a row that each gain less than
    ``tol``, or where no step along the gradient gains anything.
    """
    point, (loss, slope) = start, evaluate(start)
    losses, past, flat = [loss], [], 0
    for _ in range(max_iter):
        direction, kept = -slope, []
        for moved, changed in reversed(past):
            share = moved @ direction / (moved @ changed)
            direction = direction - share * changed
            kept.append(share)
        if past:
            moved, changed = past[-1]
            direction = direction * (moved @ changed) / (changed @ changed)
        for (moved, changed), share in zip(past, reversed(kept)):
            direction = direction + moved * (share - changed @ direction / (moved @ changed))
        step = 1.0 if past else min(1.0, 1 / max(np.linalg.norm(slope), 1e-12))
        steep = slope @ direction
        for _ in range(30):
            target = point + step * direction
            found, there = evaluate(target)
            if found <= loss + 1e-4 * step * steep:
                break
            step /= 2
        else:
            if not past:
                break
            past = []  # from here along the gradient itself
            continue
        if (target - point) @ (there - slope) > 1e-10:
            past = [*past, (target - point, there - slope)][-PAST:]
        flat = flat + 1 if loss - found < tol else 0
        point, loss, slope = target, found, there
        losses.append(loss)
        if flat >= patience:
            break
    return point, losses


def fit_network(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    hidden: Sequence[int] = NEURAL_HIDDEN,
    penalty: float = NEURAL_PENALTY,
    max_iter: int = NEURAL_MAX_ITER,
    tol: float = 1e-4,
    seed: int = 1,
    weight: str | None = None,
) -> Network:
    """Fit on labels 0 and 1; features are centred and scaled by their own moments.

    The loss is the mean log loss plus half the ``penalty`` times the squared weights (not the
    offsets), shared by the ``NEURAL_BATCH`` rows of the batch that the penalty is meant for, so
    its strength does not change with the number of rows.  A missing value is an error.  Every
    step passes over all rows; they are kept in memory and on disk meanwhile.
    """
    features, columns = tuple(features), [*features, label, *([weight] if weight else [])]
    rows = df.select([F.col(c).cast("double").alias(c) for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    moments = [f(F.col(c)).alias(f"{f.__name__}_{i}") for i, c in enumerate(features) for f in (F.avg, F.stddev_pop)]
    try:
        found = rows.agg(F.count(F.lit(1)).alias("n"), *moments).first()
        if not found["n"]:
            raise ValueError("no rows to fit on")
        tasks = rows.select(F.spark_partition_id().alias("task")).distinct().count()
        means = np.array([found[f"avg_{i}"] or 0.0 for i in range(len(features))])
        scales = np.array([found[f"stddev_pop_{i}"] or 1.0 for i in range(len(features))])
        sizes = [len(features), *hidden, 1]
        draw = np.random.default_rng(seed)
        start = _flat([
            (draw.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])
        ])
        # 1 at weights, 0 at offsets
        penalised = _flat([(np.ones((a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])])
        strength = penalty / min(NEURAL_BATCH, found["n"])

        def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray]:
            def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                layers, total = _cut(flat, sizes), np.zeros(len(flat) + 2)
                for batch in batches:
                    for at in range(0, batch.num_rows, SLICE):
                        values = _matrix(batch.slice(at, SLICE), columns)
                        x = (values[:, : len(features)] - means) / scales
                        y = values[:, len(features)]
                        total += loss_and_gradient(layers, x, y, values[:, -1] if weight else np.ones(len(y)))
                yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["part"])

            total = summed(rows.mapInArrow(partial, "part binary"), tasks)
            loss = total[1] / total[0] + strength / 2 * (penalised * flat) @ flat
            return loss, total[2:] / total[0] + strength * penalised * flat

        flat, losses = descend(evaluate, start, max_iter, tol)
    finally:
        rows.unpersist()
    return Network(features, means, scales, _cut(flat, sizes), tuple(losses))


def network_scores(network: Network, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Kept columns with ``pred`` and the probability of class 1 (``p``), by matrix products over Arrow batches."""
    kept = df.select(*keep).schema
    schema = StructType([*kept.fields, StructField("pred", IntegerType()), StructField("p", DoubleType())])
    inputs = [f"_x{i}" for i in range(len(network.features))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                p = network.share(_matrix(rows, inputs))
                arrays = [*rows.columns[: len(keep)], pa.array((p > 0.5).astype(np.int32)), pa.array(p)]
                yield pa.record_batch(arrays, names=[*keep, "pred", "p"])

    values = [F.col(f).cast("double").alias(n) for f, n in zip(network.features, inputs)]
    return df.select(*keep, *values).mapInArrow(work, schema)


def network_share(network: Network) -> Column:
    """The same probability as one expression over the feature columns, without Python at run time.

    For small networks or where rows must stay in the JVM: every product is an element of an
    array expression, which takes far longer than the matrix products of ``network_scores``.
    """

    scaled = [
        (F.col(f).cast("double") - float(m)) / float(s) for f, m, s in zip(network.features, network.means, network.scales)
    ]
    values = F.array(*scaled)
    for weights, bias in network.layers[:-1]:
        values = F.transform(_layer_column(values, weights, bias), lambda total: F.greatest(total, F.lit(0.0)))
    return 1 / (1 + F.exp(-_layer_column(values, *network.layers[-1])[0]))


def _layer_column(values: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    """Totals of one layer's units.  ``values`` is bound to a variable, or each unit would compute it again."""

    def constant(numbers: np.ndarray) -> Column:
        return F.from_json(F.lit(json.dumps(numbers.tolist())), "array<" * numbers.ndim + "double" + ">" * numbers.ndim)

    def total(held: Column) -> Column:
        def unit(row: Column, offset: Column) -> Column:
            return F.aggregate(F.zip_with(row, held, lambda a, b: a * b), offset, lambda a, b: a + b)

        return F.zip_with(constant(weights.T), constant(bias), unit)

    return F.transform(F.array(values), total)[0]
