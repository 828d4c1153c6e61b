"""Packing under mixture control: deficit round-robin over source queues.

Each source is a queue of the tokens of its documents in a seeded order. In each round a source is credited its share
of one window (window length times its tokens over all tokens) and sends as many whole units of ``quantum`` tokens as
its credit covers; what is left of the credit, less than one unit, is carried to the next round. Sources take turns in
a fixed order, the rounds follow each other in one stream, and the stream is cut every ``window`` tokens, so each window
holds the corpus mixture to one unit per source, and only the last window is padded.

The carried deficit needs no walk over the rounds: the unit that ends at token E of a queue is sent in the first round
whose total credit reaches E. A document's pieces follow from its place in its queue, and their places in the stream
from running totals over ranges of rounds. So deficits are carried over windows and partitions exactly, and no queue,
however long, is held by one task. Ids meet their pieces in one join by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.llm.shared import (
    digits_of,
    hash_fraction,
    key_text,
    row_slices,
    running_total,
    second_digits,
    stored,
)
from planshift.llm.word_ids import piece_ids


def encoded(docs: DataFrame, vocabulary_file: str, key: str, text: str, source: str, end_id: int) -> DataFrame:
    """Per document ``__row``, ``__key``, ``__source``, ``__n`` and the ids (two bytes each, end id included), stored."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_ids(vocabulary_file, "word")
        if encoder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in two bytes")
        for batch in batches:
            for rows in row_slices(batch, "__text", 2 << 20):
                ids, bounds = encoder.encode(rows.column(2))
                ids = np.insert(ids.astype("<u2"), bounds[1:], end_id)
                lengths = np.diff(bounds) + 1
                offsets = np.concatenate([[0], np.cumsum(2 * lengths)])
                data = pa.Array.from_buffers(
                    pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]
                )
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), pa.array(lengths), data.cast(pa.binary())],
                    names=["__key", "__source", "__n", "__ids"],
                )

    rows = docs.select(F.col(key).alias("__key"), key_text(source).alias("__source"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    made = rows.mapInArrow(encode, f"__key {kind}, __source string, __n long, __ids binary")
    return stored(made.withColumn("__row", F.monotonically_increasing_id()), "packing-ids")


def round_pieces(placed: DataFrame, total: int, window: int, quantum: int) -> DataFrame:
    """Cuts every document where its queue goes on to another round."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, before, whole = (batch.column(c).to_numpy() for c in ("__row", "__n", "__before", "__queue"))
            first, last = before // quantum, (before + n - 1) // quantum
            count = last - first + 1
            of = np.repeat(np.arange(len(row)), count)
            unit = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
            end = np.minimum((unit + 1) * quantum, whole[of])
            turn = np.ceil(end * (total / (float(window) * whole[of]))).astype(np.int64)
            new = np.ones(len(of), dtype=bool)
            new[1:] = (of[1:] != of[:-1]) | (turn[1:] != turn[:-1])
            at = np.flatnonzero(new)
            doc = of[at]
            start = np.maximum(unit[at] * quantum - before[doc], 0)
            stop = np.append(start[1:], 0)
            ends = np.append(doc[1:] != doc[:-1], True)
            stop[ends] = n[doc[ends]]
            yield pa.record_batch(
                [pa.array(row[doc]), batch.column("__source").take(pa.array(doc)), pa.array(turn[at]),
                 pa.array(before[doc] + start), pa.array(start), pa.array(stop - start)],
                names=["__row", "__source", "__turn", "__from", "__start", "__length"],
            )

    return placed.select("__row", "__source", "__n", "__before", "__queue").mapInArrow(
        cut, "__row long, __source string, __turn long, __from long, __start long, __length long"
    )


def with_checksums(joined: DataFrame, key_type: str) -> DataFrame:
    """One row per piece; pieces that follow each other in document and window are one."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__pieces")
            bounds = lists.offsets.to_numpy()
            fields = {f.name: lists.values.field(i).to_numpy() for i, f in enumerate(lists.type.value_type)}
            data, n = batch.column("__ids"), batch.column("__n").to_pylist()
            out = {c: [] for c in ("of", "start", "length", "check", "sequence", "offset")}
            for i in range(batch.num_rows):
                own = slice(bounds[i], bounds[i + 1])
                order = np.argsort(fields["start"][own])
                start, length, sequence, offset = (fields[c][own][order] for c in ("start", "length", "sequence", "offset"))
                new = np.ones(len(start), dtype=bool)
                new[1:] = (sequence[1:] != sequence[:-1]) | (offset[1:] != offset[:-1] + length[:-1])
                at = np.flatnonzero(new)
                start, sequence, offset = start[at].tolist(), sequence[at].tolist(), offset[at].tolist()
                ids = memoryview(np.frombuffer(data[i].as_buffer(), "<u2").astype("<u4").tobytes())
                stop = [*start[1:], n[i]]
                out["of"] += [i] * len(start)
                out["start"] += start
                out["length"] += [b - a for a, b in zip(start, stop, strict=True)]
                out["check"] += [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(start, stop, strict=True)]
                out["sequence"] += sequence
                out["offset"] += offset
            of = pa.array(out["of"], pa.int64())
            long = lambda c: pa.array(out[c], pa.int64())
            yield pa.record_batch(
                [batch.column("__key").take(of), long("start"), long("length"), long("check"),
                 batch.column("__n").take(of), long("sequence"), long("offset")],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return joined.select("__key", "__n", "__ids", "__pieces").mapInArrow(
        check,
        f"doc_id {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def packed(
    docs: DataFrame,
    vocabulary_file: str,
    window: int = 4096,
    quantum: int = 64,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    end_id: int = 2,
    seed: int = 41,
) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens; each id lies in exactly one piece.

    Returns ``doc_id`` (the key), ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``.
    Null and empty texts have the end id alone. Null sources are one queue. Rows that repeat a key are packed each by
    itself. An empty table gives no rows. Other columns are not read.
    """
    ids = encoded(docs, vocabulary_file, key, text, source, end_id)
    total, count = ids.agg(F.sum("__n"), F.count(F.lit(1))).first()
    # with the row's number, so that rows that repeat a key are spread
    order_key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("__key").cast("string"), F.lit("null")), F.col("__row").cast("string")))
    d1, d2 = digits_of(hash_fraction(F.col("__h")), second_digits(count))
    queues = ids.select("__row", "__source", "__n", order_key.alias("__h")).withColumns({"__d1": d1, "__d2": d2})
    placed = running_total(queues, ["__source"], ["__h", "__row"], "__n", "__before", "__queue")
    pieces = stored(round_pieces(placed, total or 1, window, quantum), "packing-pieces")
    turns = -(-(total or 1) // window) + 1
    d1, d2 = digits_of((F.col("__turn") - 1) / float(turns), second_digits(pieces.count()))
    stream = running_total(
        pieces.withColumns({"__d1": d1, "__d2": d2}), [], ["__turn", "__source", "__from"], "__length", "__at", "__all"
    )
    first, last = F.expr(f"__at div {window}"), F.expr(f"(__at + __length - 1) div {window}")
    cut = stream.withColumn("__w", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("__w") * window, F.col("__at"))
    stop = F.least((F.col("__w") + 1) * window, F.col("__at") + F.col("__length"))
    piece = F.struct(
        (F.col("__start") + begin - F.col("__at")).alias("start"), (stop - begin).alias("length"),
        F.col("__w").alias("sequence"), (begin - F.col("__w") * window).alias("offset"),
    )
    by_row = cut.groupBy("__row").agg(F.collect_list(piece).alias("__pieces"))
    return with_checksums(ids.join(by_row, "__row"), ids.schema["__key"].dataType.simpleString())
