"""Token ids in Arrow files of equal-length sequences, and their reading.

Documents are range-partitioned and sorted by key; the task of each range writes one Arrow file (the stream of record
batches between the file's head and its footer of batch offsets) with two fixed-size-list columns, ``ids`` and ``mask``,
of one sequence a row, and beside it one with the place of each document. Only the last sequence of a file is padded
(id 0, mask false). Since all lists have one length and all batches but the last one number of rows, any token is found
by arithmetic in a memory-mapped file, without copying. A task writes under a name of its own and then moves the file
to its final name, so retried and speculative tasks leave whole files only.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planshift.llm.shared import row_slices, stored
from planshift.llm.word_ids import piece_ids

DOC_FIELDS = [("start", pa.int64()), ("n_tokens", pa.int64())]
BATCH_SEQUENCES = 256


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; local paths may come as ``file:/...``."""
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and uri[6:7] != "/" else uri)


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them batch by batch; holds one batch at most."""

    def __init__(self, sink, length: int, dtype: type):
        self.length, self.dtype, self.parts, self.held = length, np.dtype(dtype), [], 0
        self.schema = pa.schema([
            ("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length)),
        ])
        self.file = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        full = self.length * BATCH_SEQUENCES
        at = 0
        while at < len(ids):
            piece = ids[at:at + full - self.held]
            self.parts.append(piece.astype(self.dtype))
            self.held += len(piece)
            at += len(piece)
            if self.held == full:
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.held // self.length)
        ids = np.zeros(rows * self.length, dtype=self.dtype)
        ids[:self.held] = np.concatenate(self.parts)
        mask = np.arange(len(ids)) < self.held
        self.file.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ], schema=self.schema))
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        self.file.close()


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary_file: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    sequence_length: int = 2048,
    dtype: type = np.uint16,
) -> DataFrame:
    """Writes ``docs`` under ``folder``; returns one row per file: ``part``, ``path``, ``n_docs``, ``n_tokens``.

    Files follow each other in the order of ``part``, documents in ascending ``key`` (null first; rows that repeat a key
    by a hash of their text, so that copies of any number are spread over files). Each document is its ids and ``end_id``; null and empty texts have the end id alone. ``dtype`` must
    hold every id of the vocabulary. An empty table writes no file. Other columns are not read. ``folder`` is a URI that
    Python on the executors can reach.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = piece_ids(vocabulary_file, "byte"), TaskContext.get().partitionId()
        system, root = opened(folder)
        system.create_dir(root)
        name, own = f"{root}/part-{part:06d}", f"{root}/.{uuid.uuid4().hex}"
        sink = sequences = index = index_sink = None
        n_docs = n_tokens = 0
        for batch in batches:
            for rows in row_slices(batch, "text", 2 << 20):
                if sink is None:
                    sink, index_sink = system.open_output_stream(own), system.open_output_stream(f"{own}.docs")
                    sequences = SequenceWriter(sink, sequence_length, dtype)
                    fields = pa.schema([("key", rows.column(0).type), *DOC_FIELDS])
                    index = pa.ipc.new_file(index_sink, fields)
                ids, bounds = encoder.encode(rows.column(1))
                n = len(bounds) - 1
                ids = np.insert(ids, bounds[1:], end_id)
                lengths = np.diff(bounds) + 1
                starts = n_tokens + np.cumsum(lengths) - lengths
                sequences.add(ids)
                index.write_batch(pa.record_batch([rows.column(0), pa.array(starts), pa.array(lengths)], schema=fields))
                n_docs += n
                n_tokens += len(ids)
        if sink is None:
            return
        for file in (sequences, index, sink, index_sink):
            file.close()
        system.move(own, f"{name}.arrow")
        system.move(f"{own}.docs", f"{name}.docs.arrow")
        yield pa.record_batch(
            {"part": [part], "path": [f"{folder}/part-{part:06d}"], "n_docs": [n_docs], "n_tokens": [n_tokens]}
        )

    ordered = (
        docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange("key", "hash", "row")
        .sortWithinPartitions("key", "hash", "row")
        .select("key", "text")
    )
    return stored(ordered.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-files")


class SequenceReader:
    """Random access to the ids of one file; views into the mapped file wherever a range lies in one batch."""

    def __init__(self, path: str):
        system, root = opened(path)
        local = isinstance(system, fs.LocalFileSystem)
        opener = pa.memory_map if local else system.open_input_file
        self.file = pa.ipc.open_file(opener(f"{root}.arrow"))
        self.docs = pa.ipc.open_file(opener(f"{root}.docs.arrow"))
        self.per_batch = self.file.schema.field("ids").type.list_size * BATCH_SEQUENCES
        self.at, self.values = -1, None

    def batch(self, number: int) -> np.ndarray:
        if number != self.at:
            self.at, self.values = number, self.file.get_batch(number).column(0).flatten().to_numpy()
        return self.values

    def ids(self, start: int, length: int) -> np.ndarray:
        parts = []
        for number in range(start // self.per_batch, (start + length - 1) // self.per_batch + 1):
            base = number * self.per_batch
            parts.append(self.batch(number)[max(start - base, 0):start + length - base])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch = self.file.get_batch(number // BATCH_SEQUENCES)
        return tuple(batch.column(c)[number % BATCH_SEQUENCES].values.to_numpy(zero_copy_only=False) for c in (0, 1))


def read_documents(files: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``.

    Every file is read by one task. The first id of each file comes from a running sum over one row per file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = SequenceReader(path)
                for number in range(reader.docs.num_record_batches):
                    docs = reader.docs.get_batch(number)
                    starts, lengths = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    checks = [
                        zlib.crc32(reader.ids(s, n).astype("<u4").tobytes())
                        for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)
                    ]
                    yield pa.record_batch(
                        [docs.column(0), pa.array(starts + base), docs.column(2), pa.array(checks, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks).mapInArrow(
        read, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long"
    )


