"""Helpers of the corpus operators: stored intermediates, size-checked joins, scalable running totals, word splitting."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planshift.session import work_path

# Largest side that may be broadcast; the bytes are measured or bounded before the hint is given.
BROADCAST_BYTES = 32 << 20
FIRST_DIGITS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once, and a lost executor costs no recomputation.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def key_text(column: str) -> Column:
    """A column as text that is never null, so that null is a group like any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if ``rows`` rows of at most ``row_bytes`` stay below the bound; else left to the planner."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def second_digits(rows: int, per_bucket: int = 4096) -> int:
    """Power of two by which the 256 first digits are refined so that a bucket holds about ``per_bucket`` rows."""
    wanted, digits = rows / (FIRST_DIGITS * per_bucket), 1
    while digits < wanted:
        digits *= 2
    return digits


def digits_of(fraction: Column, second: int) -> tuple[Column, Column]:
    """Two-digit bucket of a fraction in [0, 1); it grows with the fraction."""
    cell = F.least(F.floor(fraction * (FIRST_DIGITS * second)), F.lit(FIRST_DIGITS * second - 1)).cast("long")
    return F.floor(cell / second).cast("int"), (cell % second).cast("int")


def hash_fraction(hexadecimal: Column) -> Column:
    """The first 13 hexadecimal digits of a hash as a fraction in [0, 1)."""
    return F.conv(F.substring(hexadecimal, 1, 13), 16, 10).cast("double") / float(1 << 52)


def running_total(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, before: str, total: str,
    digits: Sequence[str] = ("__d1", "__d2"),
) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of the group, and over the whole group.

    ``df`` has the bucket columns ``digits``, which taken together must not decrease along ``order``. Only sums per bucket
    cross bucket limits: a group of any size is spread over its buckets, and ``df`` is shuffled once.
    """
    digits = list(digits)
    both = [*groups, *digits]
    sums = {len(digits): df.groupBy(*both).agg(F.sum(value).alias("__s"))}
    for k in range(len(digits) - 1, 0, -1):
        sums[k] = sums[k + 1].groupBy(*groups, *digits[:k]).agg(F.sum("__s").alias("__s"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = None
    for k in range(1, len(digits) + 1):
        parent = [*groups, *digits[:k - 1]]
        whole = Window.partitionBy(*parent)
        ahead = F.coalesce(F.sum("__s").over(earlier(whole.orderBy(digits[k - 1]))), F.lit(0)).alias(f"__b{k}")
        level = sums[k].select(*parent, digits[k - 1], ahead, *([F.sum("__s").over(whole).alias(total)] if k == 1 else []))
        bases = level if bases is None else level.join(bases, parent)
    bases = bases.select(*both, sum(F.col(f"__b{k + 1}") for k in range(len(digits))).alias("__b"), total)
    inside = earlier(Window.partitionBy(*both).orderBy(*order))
    return (
        df.join(bases, both)
        .withColumn(before, F.col("__b") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__b", *[d for d in digits if d not in order])
    )


def copy_numbers(rows: DataFrame, same: Sequence[str], piece: str) -> DataFrame:
    """Adds ``__copy``: 0, 1, 2, ... among the rows that are equal in ``same``, which holds no nulls.

    ``rows`` is stored, and ``piece`` tells the parts that it was stored in: copies are numbered inside a part and go on
    over the counts of earlier parts, so any number of them is spread.
    """
    both = [*same, piece]
    counts = rows.groupBy(*both).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*same).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__b", F.sum("__n").over(earlier)).filter(F.col("__b").isNotNull()).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*both).orderBy(piece)) - 1
    placed = rows.withColumn("__in", inside).join(bases, both, "left")
    return placed.withColumn("__copy", F.col("__in") + F.coalesce("__b", F.lit(0))).drop("__in", "__b")


def tidy() -> None:
    """Hands freed memory of a worker back, so that the workers of one executor do not all hold their peaks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def row_slices(batch: pa.RecordBatch, text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no slice holds much more than ``most_bytes`` of text; a single longer text stays whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    tidy()


def listed(strings: pa.Array, apart: str) -> list[str]:
    """A Python list of strings that do not contain ``apart``; several times faster than ``to_pylist``."""
    if not len(strings):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings)
    return pc.binary_join(whole, pa.scalar(apart, strings.type))[0].as_py().split(apart)


class Words:
    """The white-space separated words of a column of texts: distinct words, the code of every word, bounds by text."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        self.distinct: list[str] = listed(coded.dictionary, " ")
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if "" in self.distinct:  # leading or trailing white space
            full = codes != self.distinct.index("")
            offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
            codes = codes[full]
        self.codes, self.bounds = codes, offsets
