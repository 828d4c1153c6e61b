"""Importance resampling towards a target distribution, with a head-tail vocabulary.

The features of a text are all runs of one to three consecutive words; a feature's bucket is its CRC-32 modulo the
number of buckets. Bucket totals of the raw and of the target texts are exact and give every bucket a gain, a text's
weight is the sum of its features' gains, and Gumbel noise from its key turns the highest scores into a weighted sample
without replacement.

A first pass over all texts finds the head: the words and pairs that are frequent in some slice of texts, the most
frequent of them overall. The head is bounded by ``HEAD_WORDS`` and ``HEAD_PAIRS`` and is broadcast with its CRC states;
it only saves work. Words outside it take the CRC of their bytes. A longer run goes on from the state of its first words:
CRC-32 is linear, so the state after more bytes is the state moved over that many zero bytes, by tables of 256 entries,
exclusive-or the CRC of the bytes. Head pairs take their state from the table instead. Both feed the same totals.

Buckets of all features are computed once and stored as two bytes each; totals and weights read those alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.llm.shared import Words, row_slices, stored
from planshift.operators.ranking import global_rank

BUCKETS = 10_000
# Sizes of the head, whatever the corpus; entries of more bytes stay in the tail.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 4096, 8192, 64
# A word or pair is reported by a slice of texts if it makes up one of so many words there.
HEAD_ONE_IN = 4000
SLICE_BYTES = 4 << 20
KEPT = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def lowered(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and a space for every other ASCII character that is no letter or digit; null: empty."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = whole.buffers()
    moved = data.to_pybytes().translate(KEPT) if data is not None else b""
    return pa.LargeStringArray.from_buffers(len(whole), offsets, pa.py_buffer(moved), None, 0, whole.offset)


def _tables(columns: np.ndarray) -> np.ndarray:
    """Four tables of 256 entries of the linear map that takes bit k to ``columns[k]``."""
    value = np.arange(256)
    bits = (value[:, None] >> np.arange(8)) & 1
    return np.stack([
        np.bitwise_xor.reduce(np.where(bits == 1, columns[8 * k:8 * k + 8], np.uint32(0)), axis=1) for k in range(4)
    ]).astype(np.uint32)


def _mapped(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return (
        tables[0, state & 255] ^ tables[1, (state >> 8) & 255] ^ tables[2, (state >> 16) & 255] ^ tables[3, state >> 24]
    )


@lru_cache(maxsize=64)
def _doubled(power: int) -> np.ndarray:
    """Tables of the move over 2 ** ``power`` zero bytes."""
    if power:
        half = _doubled(power - 1)
        return _tables(_mapped(half, _mapped(half, np.uint32(1) << np.arange(32, dtype=np.uint32))))
    # one zero byte after the state c, without the inversions at both ends
    c = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1)).astype(np.uint32)
    return _tables(c)


@lru_cache(maxsize=2048)
def moved_over(length: int) -> np.ndarray:
    """Tables of the move of a CRC-32 over ``length`` bytes: crc(a + b) = moved(crc(a)) ^ crc(b)."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for power in range(length.bit_length()):
        if length >> power & 1:
            columns = _mapped(_doubled(power), columns)
    return _tables(columns)


def continued(state: np.ndarray, length: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings with the CRCs ``state``, each followed by one of ``length`` bytes with the CRC ``crc``."""
    kinds, place = np.unique(length, return_inverse=True)
    if not len(kinds):
        return np.zeros(0, dtype=np.uint32)
    tables = np.concatenate([moved_over(int(n)).ravel() for n in kinds])
    at = place.astype(np.int64) * 1024
    out = crc.copy()
    for k in range(4):
        out ^= tables[at + k * 256 + ((state >> np.uint32(8 * k)) & np.uint32(255))]
    return out


@dataclass(frozen=True)
class Head:
    """CRC states of frequent words, and of frequent pairs under first * ``HEAD_WORDS`` + second place, ascending."""

    words: Mapping[str, int]
    crc: np.ndarray
    pairs: np.ndarray
    pair_crc: np.ndarray


def _same_text(bounds: np.ndarray, words: int, apart: int) -> np.ndarray:
    """Whether the word ``apart`` places later is in the same text; one entry per word."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(words) + apart < end


def frequent(docs: DataFrame, text: str) -> Head:
    """The head of all texts of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "__text", SLICE_BYTES):
                words = Words(lowered(rows.column(0)))
                codes, size = words.codes.astype(np.int64), len(words.distinct)
                least = max(2.0, len(codes) / HEAD_ONE_IN)
                counts = np.bincount(codes, minlength=size)
                often = counts >= least
                found = [(words.distinct[i], None, int(counts[i])) for i in np.flatnonzero(often)]
                first = np.flatnonzero(_same_text(words.bounds, len(codes), 1))
                first = first[often[codes[first]] & often[codes[first + 1]]]
                pairs, times = np.unique(codes[first] * size + codes[first + 1], return_counts=True)
                for key, n in zip(pairs[times >= least].tolist(), times[times >= least].tolist(), strict=True):
                    found.append((words.distinct[key // size], words.distinct[key % size], n))
                found = [f for f in found if len((f[0] + (f[1] or "")).encode()) <= HEAD_BYTES]
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                kinds = (pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "n"])

    seen = docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(work, "a string, b string, n long")
    seen = stored(seen.groupBy("a", "b").agg(F.sum("n").alias("n")), "head")
    order = [F.desc("n"), "a", "b"]
    words = {r["a"]: i for i, r in enumerate(seen.filter("b is null").orderBy(*order).limit(HEAD_WORDS).collect())}
    pairs = sorted(
        (words[r["a"]] * HEAD_WORDS + words[r["b"]], zlib.crc32(f"{r['a']} {r['b']}".encode()))
        for r in seen.filter("b is not null").orderBy(*order).limit(HEAD_PAIRS).collect()
        if r["a"] in words and r["b"] in words
    )
    return Head(
        words, np.asarray([zlib.crc32(w.encode()) for w in words], dtype=np.uint32),
        np.asarray([k for k, _ in pairs], dtype=np.int64), np.asarray([c for _, c in pairs], dtype=np.uint32),
    )


def feature_buckets(texts: pa.Array, head: Head, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of all texts, their bounds by text, and the words of each text."""
    words = Words(lowered(texts))
    codes, n = words.codes, len(words.codes)
    place = np.asarray([head.words.get(w, -1) for w in words.distinct], dtype=np.int64)
    own = np.zeros(len(place), dtype=np.uint32)
    own[place >= 0] = head.crc[place[place >= 0]]
    spoken = [w.encode() for w in words.distinct]
    for i in np.flatnonzero(place < 0).tolist():
        own[i] = zlib.crc32(spoken[i])
    size = np.asarray([len(w) + 1 for w in spoken], dtype=np.int64)
    spaced = continued(np.full(len(own), zlib.crc32(b" "), dtype=np.uint32), size - 1, own)  # the CRC of " word"
    runs = np.zeros((n, 3), dtype=np.uint32)
    held = np.zeros((n, 3), dtype=bool)
    held[:, 0] = True
    runs[:, 0] = own[codes]
    two = np.flatnonzero(_same_text(words.bounds, n, 1))
    after = codes[two + 1]
    first, second = place[codes[two]], place[after]
    key = np.where((first >= 0) & (second >= 0), first * HEAD_WORDS + second, -1)
    at = np.minimum(np.searchsorted(head.pairs, key), max(len(head.pairs) - 1, 0))
    known = head.pairs[at] == key if len(head.pairs) else np.zeros(len(two), dtype=bool)
    state = np.zeros(len(two), dtype=np.uint32)
    state[known] = head.pair_crc[at[known]] if len(head.pairs) else 0
    tail = ~known
    state[tail] = continued(runs[two[tail], 0], size[after[tail]], spaced[after[tail]])
    runs[two, 1], held[two, 1] = state, True
    three = np.flatnonzero(_same_text(words.bounds, n, 2))
    last = codes[three + 2]
    runs[three, 2], held[three, 2] = continued(runs[three, 1], size[last], spaced[last]), True
    counts = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
    return (runs[held] % np.uint32(buckets)).astype(np.uint16), counts[words.bounds], np.diff(words.bounds)


def bucketed(docs: DataFrame, head: Head, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """``__key``, ``__words``, ``__features`` and ``__buckets`` (16 bits each) of every text, stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, "__text", SLICE_BYTES):
                found, bounds, words = feature_buckets(rows.column(1), head, buckets)
                packed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(rows), [None, pa.py_buffer(2 * bounds.astype(np.int64)), pa.py_buffer(found)]
                )
                yield pa.record_batch(
                    [rows.column(0), pa.array(words, pa.int64()), pa.array(np.diff(bounds), pa.int64()), packed.cast(pa.binary())],
                    names=["__key", "__words", "__features", "__buckets"],
                )

    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    return stored(rows.mapInArrow(work, f"__key {kind}, __words long, __features long, __buckets binary"), "buckets")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of 16-bit lists, and the bounds of each list."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False) // 2
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16), bounds


def bucket_totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds; every task sends one row per bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    counted = rows.select("__buckets").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target to raw shares, by bucket, rounded down."""
    up = (target + 1.0) * (float(raw.sum()) + len(raw))
    down = (raw + 1.0) * (float(target.sum()) + len(target))
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``__key``, ``__words``, ``__features`` and ``__weight``, the sum of the gains of a text's features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bounds = _flat(batch.column(3))
            sums = np.concatenate([[0], np.cumsum(gain[found])])
            weight = sums[bounds[1:]] - sums[bounds[:-1]]
            yield pa.record_batch([*batch.columns[:3], pa.array(weight, pa.int64())], names=["__key", "__words", "__features", "__weight"])

    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(work, f"__key {kind}, __words long, __features long, __weight long")


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS,
) -> DataFrame:
    """``key``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document, ``rank`` null if it is not drawn.

    Of the documents with at least ``least_words`` words the ``percent`` % of the highest scores are drawn, ties to the
    smaller key (null the smallest), then to fewer features. A null text has no words, a null key draws its noise as the
    word null; rows that repeat a key share its noise and are documents of their own. Empty tables count no features: an
    empty target leaves only the smoothing, an empty ``docs`` gives no rows. Other columns are not read.
    """
    head = frequent(docs, text)
    rows = bucketed(docs, head, key, text, buckets)
    wanted = bucketed(target, head, target_text, target_text, buckets)
    gain = gains(bucket_totals(rows, buckets), bucket_totals(wanted, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__key").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighted(rows, gain).withColumn("__score", F.col("__weight") + noise), "scores")
    columns = [
        F.col("__key").alias(key), F.col("__features").alias("n_features"), F.col("__weight").alias("weight"),
        F.col("__score").alias("score"),
    ]
    order = [F.desc("__score"), F.col("__key").asc_nulls_first(), F.col("__features").asc()]
    ranked = global_rank(scored.filter(F.col("__words") >= least_words), order, (), "__rank", "__eligible")
    drawn = F.expr(f"{percent} * __eligible div 100")
    inside = ranked.select(*columns, F.when(F.col("__rank") <= drawn, F.col("__rank").cast("long")).alias("rank"))
    short = scored.filter(F.col("__words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return inside.union(short)
