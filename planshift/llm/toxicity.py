"""Toxicity by a counterfactually regularised classifier.

A logistic model over which words and word beginnings a text holds. Its training loss adds, for every labelled sentence
that names an identity group, the squared difference between the scores of the sentence and of the same sentence with
the identity term swapped for another of its group. A term that only names a group then cannot carry weight of its
own, so neutral mentions are not taken for toxic ones.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_PER_CLASS`` rows of each label, by hash order); its
features are those of that sample that tell the classes apart. Scoring reads every whole text once, looks each distinct
word of a batch up once, and needs no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planshift.llm.labelled import bounded_sample
from planshift.llm.shared import Words, row_slices, stored

# Most labelled rows of each class that the fit sees; the driver holds their features alone.
SAMPLE_PER_CLASS = 4_000
MOST_FEATURES = 20_000
# Groups of terms that may stand for each other in a sentence.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "native", "refugee"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
SWAPS: Mapping[str, tuple[str, ...]] = {
    t: tuple(o for o in group if o != t) for group in IDENTITY_TERMS for t in group
}
LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """Features of one white-space separated word: its runs of letters, lower-cased, and their beginnings (ending in *)."""
    out = []
    for run in LETTERS.findall(unicodedata.normalize("NFC", word).lower()):
        out.append(run)
        out += [f"{run[:n]}*" for n in (4, 5) if len(run) > n]
    return out


Change = tuple[tuple[str, ...], tuple[str, ...]]


def sentence_swaps(text: str) -> Counter[Change]:
    """How often which features go and which come when a group term of a sentence is swapped for another of its group.

    Every sentence of the whole text counts; features that other words of the sentence hold do not change.
    """
    found: Counter[Change] = Counter()
    for sentence in re.split(r"[.!?\n]+", unicodedata.normalize("NFC", text)):
        words = Counter(LETTERS.findall(sentence.lower()))
        terms = [w for w in words if w in SWAPS]
        if not terms:
            continue
        holders: Counter[str] = Counter()
        for word, times in words.items():
            holders.update(dict.fromkeys(features_of(word), times))
        for word in terms:
            own = features_of(word)
            for other in SWAPS[word]:
                new = features_of(other)
                gone = sorted(f for f in own if f not in new and holders[f] == 1)
                come = sorted(f for f in new if not holders[f])
                found[tuple(gone), tuple(come)] += words[word]
    return found


@dataclass(frozen=True)
class ToxicModel:
    """Bias and weights by feature; a text scores the logistic of the bias and the weights of the features it holds."""

    bias: float
    weights: Mapping[str, float]

    def scores(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts)
        index = {f: i for i, f in enumerate(self.weights)}
        weight = np.fromiter(self.weights.values(), dtype=float, count=len(index))
        held = [[index[f] for f in features_of(w) if f in index] for w in words.distinct]
        counts = np.asarray([len(h) for h in held], dtype=np.int64)
        flat = np.asarray([f for h in held for f in h], dtype=np.int64)
        begin = np.cumsum(counts) - counts
        text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        hit = counts[words.codes] > 0 if len(words.codes) else np.zeros(0, dtype=bool)
        codes, text = words.codes[hit], text[hit]
        n = counts[codes]
        at = np.repeat(begin[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(text, n) * max(len(index), 1) + flat[at])
        margin = np.bincount(pairs // max(len(index), 1), weights=weight[pairs % max(len(index), 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(margin + self.bias, -500, 500)))


def held_out(key: str) -> Column:
    """Rows that no fit may see: crc32 of the key as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def sample_features(sample: DataFrame) -> DataFrame:
    """``label``, distinct features (``held``) and counted swaps (``swaps``) of each sampled text, stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "__text"):
                texts = [t or "" for t in rows.column(0).to_pylist()]
                found = [sorted({f for w in set(t.split()) for f in features_of(w)}) for t in texts]
                swaps = [
                    [{"gone": list(gone), "come": list(come), "n": n} for (gone, come), n in sentence_swaps(t).items()]
                    for t in texts
                ]
                yield pa.record_batch(
                    [rows.column(1), pa.array(found, held), pa.array(swaps, swapped)], names=["label", "held", "swaps"]
                )

    held = pa.list_(pa.string())
    swapped = pa.list_(pa.struct([("gone", held), ("come", held), ("n", pa.int64())]))
    schema = "label int, held array<string>, swaps array<struct<gone: array<string>, come: array<string>, n: bigint>>"
    return stored(sample.mapInArrow(work, schema), "toxic-sample")


def known_features(rows: DataFrame, index: Mapping[str, int]) -> list[tuple[int, list[int]]]:
    """Label and places of the known features of each sampled text; as many as the sample bound allows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[index[f] for f in fs if f in index] for fs in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(held, pa.list_(pa.int32()))], names=["label", "held"])

    found = rows.select("label", "held").mapInArrow(work, "label int, held array<int>").collect()
    return sorted((r["label"], sorted(r["held"])) for r in found)


def counted_swaps(rows: DataFrame, index: Mapping[str, int]) -> list[tuple[list[int], list[int], int]]:
    """Places that go and come, and how often over the whole sample; there are few distinct swaps of few terms."""
    swaps = rows.select(F.explode("swaps").alias("s")).groupBy("s.gone", "s.come").agg(F.sum("s.n").alias("n"))
    places = lambda features: [index[f] for f in features if f in index]
    return sorted((places(r["gone"]), places(r["come"]), r["n"]) for r in swaps.collect())


def chosen_features(counts: DataFrame, n: int, positive: int, least: int = 3, least_chi: float = 10.83) -> dict[str, int]:
    """Features in ``least`` sampled texts or more whose chi-square against the label passes the 0.1 % point."""
    a, m = F.col("pos").cast("double"), F.col("n").cast("double")
    c, rest = positive - a, n - m
    chi = n * (a * (rest - c) - (m - a) * c) ** 2 / (m * rest * positive * float(max(n - positive, 1)))
    kept = (
        counts.filter((m >= least) & (rest > 0))
        .withColumn("chi", chi)
        .filter(F.col("chi") >= least_chi)
        .orderBy(F.desc("chi"), "f")
        .limit(MOST_FEATURES)
    )
    return {r["f"]: i for i, r in enumerate(kept.collect())}


def fitted(
    labels: np.ndarray, rows: Sequence[np.ndarray], swaps: Sequence[tuple[list[int], list[int], int]], size: int,
    ridge: float = 1e-4, fairness: float = 1.0, rounds: int = 400, rate: float = 0.2,
) -> tuple[float, np.ndarray]:
    """Bias and weights by Adam on balanced logistic loss + ridge |w|^2 + fairness * mean squared swap difference.

    The mean is over all swaps of all sentences; equal ones come once, with their count.
    """
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    held = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    d_of = np.repeat(np.arange(len(swaps)), np.asarray([len(a) + len(b) for a, b, _ in swaps], dtype=np.int64))
    d_held = np.asarray([f for a, b, _ in swaps for f in (*a, *b)], dtype=np.int64)
    d_sign = np.asarray([sign for a, b, _ in swaps for sign in (*[1.0] * len(a), *[-1.0] * len(b))])
    times = np.asarray([n for *_, n in swaps], dtype=float)
    share = labels.mean()
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    w = np.zeros(size + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        margin = np.bincount(of, weights=w[held], minlength=len(rows)) + w[size]
        error = balance * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels)
        slope = np.append(np.bincount(held, weights=error[of], minlength=size)[:size] + ridge * w[:size], error.sum())
        if len(swaps):
            gap = times * np.bincount(d_of, weights=d_sign * w[d_held], minlength=len(swaps))
            slope[:size] += 2 * fairness / times.sum() * np.bincount(d_held, weights=d_sign * gap[d_of], minlength=size)[:size]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return float(w[size]), w[:size]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = SAMPLE_PER_CLASS, fairness: float = 1.0,
) -> ToxicModel:
    """The classifier, from labelled rows that are not held out.

    Labels other than 0 and 1 and labels without a document are left out. The bound of ``per_class`` holds for rows, also
    where keys are repeated.
    With labels of one class only the model is a bias for that class; without labels nothing is called toxic.
    """
    rows = sample_features(bounded_sample(docs, labels, key, text, label, held_out(key), per_class))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    n, positive = int(size["n"]), int(size["pos"])
    if positive == 0 or positive == n:
        return ToxicModel(4.0 if n and positive == n else -4.0, {})
    counts = rows.select("label", F.explode("held").alias("f")).groupBy("f")
    counts = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("pos"))
    index = chosen_features(counts, n, positive)
    terms = {f for t in SWAPS for f in features_of(t)}
    wanted = sorted(set(index) | terms)
    index = {f: i for i, f in enumerate(wanted)}
    sample = known_features(rows, index)
    swaps = [swap for swap in counted_swaps(rows, index) if swap[0] or swap[1]]
    bias, weights = fitted(
        np.asarray([float(c) for c, _ in sample]), [np.asarray(h, dtype=np.int64) for _, h in sample], swaps, len(index),
        fairness=fairness,
    )
    return ToxicModel(bias, {f: float(w) for f, w in zip(wanted, weights, strict=True) if abs(w) > 1e-6})


def scored(docs: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every document.

    Null, empty and wordless texts get the score of the bias. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "__text"):
                scores = model.scores(rows.column(2))
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    names=["key", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col(key).alias("__key"), held_out(key).alias("__held"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    made = rows.mapInArrow(work, f"key {kind}, held_out boolean, score double, predicted int")
    return made.withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model calls toxic; all columns stay. Scored in place, nothing is shuffled."""
    names = docs.columns
    place = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, text):
                yield rows.filter(pa.array(model.scores(rows.column(place)) < 0.5))

    return docs.mapInArrow(work, docs.schema)
