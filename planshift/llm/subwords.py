"""Quality classifier of supervised subword embeddings.

Every word, every run of ``GRAMS`` characters of a word between its borders, every pair of neighbouring words and the
end of the text is hashed to one of ``BUCKETS`` learned vectors. The mean of a document's vectors goes through a linear
layer and a softmax. Vectors and layer are trained together by stochastic gradient descent in numpy, one document a step.

A pair of equal words has one feature whatever the word, so that texts that stammer are alike.

The fit sees at most ``SAMPLE_PER_CLASS`` labelled rows of each class, dealt by hash into ``PARTS`` parts. In each of
``ROUNDS`` rounds every part trains its own copy of the model for ``EPOCHS`` epochs inside a task, and the copies are
averaged; only parameters, of fixed size, reach the driver. As a document's margin is linear in its mean, scoring folds
vectors and layer into one number per bucket, sums it once per distinct word of a batch, and shuffles nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planshift.llm.labelled import bounded_sample
from planshift.llm.shared import Words, row_slices, stored

BUCKETS = 1 << 16
WIDTH = 8
GRAMS = (3, 4)
# Most labelled rows of each class that the fit sees.
SAMPLE_PER_CLASS = 2_000
PARTS, ROUNDS, EPOCHS, RATE = 4, 5, 3, 2.0
BORDER = "\x03"  # stands at both ends of a word; ASCII control characters inside words are read as borders


def _spread(x: np.ndarray) -> np.ndarray:
    """64-bit numbers to buckets."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)).astype(np.int64) % BUCKETS


END = int(_spread(np.asarray([zlib.crc32(b"end of text")], dtype=np.uint64))[0])
STAMMER = int(_spread(np.asarray([zlib.crc32(b"the same word again")], dtype=np.uint64))[0])


def word_features(distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, the buckets of its own features (the word and its character runs), and their bounds."""
    own = np.fromiter((zlib.crc32(w.encode()) for w in distinct), dtype=np.uint64, count=len(distinct))
    points = np.frombuffer((BORDER + BORDER.join(distinct) + BORDER).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
    # word of every point; a border belongs to the word after it
    owner = np.repeat(np.arange(len(distinct) + 1), np.append(lengths + 1, 1))
    edge = np.zeros(len(points) + 1, dtype=np.int64)
    edge[1:] = np.cumsum(points == ord(BORDER))
    of, found = [np.arange(len(distinct))], [_spread(own)]
    for n in GRAMS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        value = np.full(size, n, dtype=np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) ^ points[k:k + size]
        inner = edge[n - 1:n - 1 + size] - edge[1:1 + size]  # borders that are neither first nor last
        at = np.flatnonzero(inner == 0)
        of.append(owner[at])
        found.append(_spread(value[at]))
    of, found = np.concatenate(of), np.concatenate(found)
    order = np.argsort(of, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(distinct))[:len(distinct)])])
    return own, found[order], bounds


def pair_features(words: Words, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first word of every pair of neighbours in a text, and the buckets of the pairs."""
    codes = words.codes
    end = np.repeat(words.bounds[1:], np.diff(words.bounds))
    first = np.flatnonzero(np.arange(len(codes)) + 1 < end)
    a, b = codes[first], codes[first + 1]
    value = _spread(own[a] * np.uint64(0x100000001B3) + own[b] + np.uint64(0x2545F4914F6CDD1D))
    return first, np.where(a == b, STAMMER, value)


@dataclass(frozen=True)
class SubwordModel:
    """Vectors by bucket, the output layer and its bias, for the classes 0 and 1."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def scores(self, texts: pa.Array, folded: np.ndarray | None = None) -> np.ndarray:
        """Probability of class 1 of every text; null and empty texts have the end of the text as their only feature."""
        folded = self.folded() if folded is None else folded
        words = Words(texts)
        n = np.diff(words.bounds)
        sums, counts = np.full(len(n), folded[END]), np.ones(len(n))
        if len(words.codes):
            own, found, bounds = word_features(words.distinct)
            upto = np.concatenate([[0.0], np.cumsum(folded[found])])
            text = np.repeat(np.arange(len(n)), n)
            sums += np.bincount(text, weights=(upto[bounds[1:]] - upto[bounds[:-1]])[words.codes], minlength=len(n))
            counts += np.bincount(text, weights=np.diff(bounds)[words.codes], minlength=len(n))
            first, pairs = pair_features(words, own)
            sums += np.bincount(text[first], weights=folded[pairs], minlength=len(n))
            counts += np.bincount(text[first], minlength=len(n))
        margin = sums / counts + self.bias[1] - self.bias[0]
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

    def folded(self) -> np.ndarray:
        """What a bucket adds to the margin of class 1 over class 0."""
        return (self.vectors.astype(float) @ (self.layer[:, 1] - self.layer[:, 0])).ravel()


def sample_features(sample: DataFrame, parts: int) -> DataFrame:
    """``part``, ``place``, ``label``, distinct buckets and their shares of every sampled text, stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "__text", 4 << 20):
                words = Words(rows.column(0))
                own, found, bounds = word_features(words.distinct)
                first, pairs = pair_features(words, own)
                cut = np.searchsorted(first, words.bounds)
                held, shares = [], []
                for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
                    kinds, times = np.unique(words.codes[a:b], return_counts=True)
                    sizes = bounds[kinds + 1] - bounds[kinds]
                    at = np.repeat(bounds[kinds] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    count = np.bincount(found[at], weights=np.repeat(times, sizes), minlength=BUCKETS)
                    count += np.bincount(pairs[cut[i]:cut[i + 1]], minlength=BUCKETS)
                    count[END] += 1
                    held.append(np.flatnonzero(count).astype(np.int32))
                    shares.append((count[held[-1]] / count.sum()).astype(np.float32))
                yield pa.record_batch(
                    [rows.column(1), rows.column(2), rows.column(3), pa.array(held, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                    names=["part", "place", "label", "held", "shares"],
                )

    digest = F.md5(F.concat_ws("|", F.col("__label").cast("string"), F.coalesce("__text", F.lit(""))))
    dealt = sample.select(
        F.col("__text"), F.pmod(F.conv(F.substring(digest, 1, 6), 16, 10).cast("int"), F.lit(parts)).alias("part"),
        digest.alias("place"), F.col("__label").alias("label"),
    )
    return stored(
        dealt.mapInArrow(work, "part int, place string, label int, held array<int>, shares array<float>"), "quality-sample"
    )


def descended(
    rows: list[tuple[int, np.ndarray, np.ndarray]], vectors: np.ndarray, layer: np.ndarray, bias: np.ndarray,
    epochs: int, rate: float, seed: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent on the softmax loss, one document a step, in a seeded order."""
    vectors, layer, bias = vectors.copy(), layer.copy(), bias.copy()
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            label, held, shares = rows[i]
            mean = shares @ vectors[held]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            vectors[held] -= rate * np.outer(shares, back)
    return vectors, layer, bias


def trained(state: tuple[np.ndarray, np.ndarray, np.ndarray], rate: float, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A round of one part: its rows to their number and the parameters that they lead to."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        columns = (frame[c] for c in ("label", "held", "shares"))
        rows = [(int(c), np.asarray(h), np.asarray(s)) for c, h, s in zip(*columns, strict=True)]
        vectors, layer, bias = descended(rows, *state, EPOCHS, rate, seed)
        return pd.DataFrame({"n": [len(rows)], "v": [vectors.tobytes()], "w": [np.append(layer, bias).tobytes()]})

    return step


def fit_quality(
    docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text",
    label: str = "quality", per_class: int = SAMPLE_PER_CLASS, seed: int = 7,
) -> SubwordModel:
    """The model, from labelled rows that are not ``held_out`` (a condition on ``labels``).

    Labels other than 0 and 1 and labels without a document are left out. The sample holds the classes alike; the bias is
    moved to the shares of all labels that are not held out. With one class only the model is a bias for it, without any
    labels every text scores 0.5.
    """
    rows = sample_features(bounded_sample(docs, labels, key, text, label, held_out, per_class), PARTS)
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = np.random.default_rng(seed)
    vectors = ((draw.random((BUCKETS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    if len(seen) < 2:
        return SubwordModel(vectors, layer, np.asarray([0.0, 0.0 if not seen else 4.0 if 1 in seen else -4.0]))
    for turn in range(ROUNDS):
        step = trained((vectors, layer, bias), RATE * (1 - turn / ROUNDS), seed + turn)
        copies = rows.groupBy("part").applyInPandas(step, "n long, v binary, w binary").collect()
        total = sum(c["n"] for c in copies)
        copies = sorted(copies, key=lambda c: bytes(c["w"]))
        vectors = sum(np.frombuffer(c["v"], dtype=np.float32) * np.float32(c["n"] / total) for c in copies).reshape(BUCKETS, WIDTH)
        small = sum(np.frombuffer(c["w"]) * (c["n"] / total) for c in copies)
        layer, bias = small[:-2].reshape(WIDTH, 2), small[-2:]
    known = labels.filter(~held_out & F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = {int(r[label]): r["n"] for r in known.collect()}
    shift = np.log(share[1] / share[0]) - np.log(seen[1] / seen[0])
    return SubwordModel(vectors, layer, bias + np.asarray([0.0, shift]))


def quality_scored(
    docs: DataFrame, model: SubwordModel, held_out: Column, limit: float = 0.7, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``held_out`` (null keys: false), ``score`` (0 to 1) and ``predicted`` (score of ``limit`` or more) of all rows.

    Null, empty and wordless texts get the score of a text that ends at once. Other columns are not read.
    """
    folded, bias = model.folded(), model.bias
    light = SubwordModel(np.zeros((0, 0)), np.zeros((0, 2)), bias)  # the folded numbers are all that scoring needs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "__text", 4 << 20):
                scores = light.scores(rows.column(2), folded)
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), pa.array(scores), pa.array((scores >= limit).astype(np.int32))],
                    names=["key", "held_out", "score", "predicted"],
                )

    rows = docs.select(
        F.col(key).alias("__key"), F.coalesce(held_out, F.lit(False)).alias("__held"), F.col(text).cast("string").alias("__text")
    )
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, held_out boolean, score double, predicted int").withColumnRenamed("key", key)
