"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; the row of rank r (from 0) of n gets the fractional rank
(r + 1/2) / n. Sorting all rows by fractional rank interleaves the sources in proportion, and cutting that order into
equal parts gives shards that all hold the corpus mixture, to one row per source and cut.

Nothing is sorted as a whole: ranks are running totals over hash buckets of a source, and the order over all rows is
a running total over ranges of the fractional rank, within equal ranks over ranges of the hash. So a source with a
third of all rows is spread over hundreds of buckets, as are very many sources of one row, and no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planshift.llm.shared import copy_numbers, digits_of, hash_fraction, key_text, running_total, second_digits, stored


def utf8_size(text: str) -> Column:
    """UTF-8 bytes of a text plus 1; a null text has no bytes."""
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")


def text_crc32(text: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))


def interleaved_shards(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", stratum: str = "source", seed: int = 17
) -> DataFrame:
    """Shard and place of every row of ``docs``.

    Returns ``key``, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``stratum``, ``shard`` (0 to ``shards`` - 1), ``slot``
    (gapless from 0 within the shard, in interleaved order). Row counts of shards differ by one at most.

    Null strata are one stratum; null texts have size 1 and checksum 0; a null key is hashed as the word null. The seeded
    order is that of a hash of key, checksum and the number among equal rows, so neither a key nor a row that is repeated
    very often makes a hot bucket. An empty table gives no rows. Other columns of ``docs``, whatever their names, are not
    read.
    """
    rows = stored(
        docs.select(
            F.col(key).alias("__key"), key_text(key).alias("__name"), key_text(stratum).alias("__stratum"),
            utf8_size(text).alias("__size"), text_crc32(text).alias("__crc"), F.lit(1).cast("long").alias("__one"),
            F.spark_partition_id().alias("__piece"),
        ),
        "shard-rows",
    )
    name = F.coalesce(F.col("__key").cast("string"), F.lit("null"))
    order_key = F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col("__crc").cast("string"), F.col("__copy").cast("string")))
    numbered = copy_numbers(rows, ["__name", "__stratum", "__crc", "__size"], "__piece")
    narrow = stored(numbered.withColumn("__h", order_key).drop("__name", "__piece", "__copy"), "shard-order")
    second = second_digits(narrow.count())
    d1, d2 = digits_of(hash_fraction(F.col("__h")), second)
    tie = ["__h", "__key", "__crc", "__size"]
    ranked = running_total(
        narrow.withColumns({"__d1": d1, "__d2": d2}), ["__stratum"], tie, "__one", "__rank", "__n"
    ).withColumn("__f", (2 * F.col("__rank") + 1) / (2.0 * F.col("__n")))
    ranked = stored(ranked, "shard-ranks")
    # rows of the same fractional rank, of which small sources may make many, are spread by their hash
    d1, d2 = digits_of(F.col("__f"), second)
    d3 = F.floor(hash_fraction(F.col("__h")) * 65536).cast("int")
    placed = running_total(
        ranked.withColumns({"__d1": d1, "__d2": d2, "__d3": d3}), [], ["__f", *tie], "__one", "__place", "__all",
        ("__d1", "__d2", "__f", "__d3"),
    )
    shard = F.expr(f"__place * {shards} div __all")
    start = F.expr(f"(__shard * __all + {shards - 1}) div {shards}")
    return placed.withColumn("__shard", shard).select(
        F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.expr("if(__stratum = 'null', null, substring(__stratum, 2))").alias("stratum"),
        F.col("__shard").cast("int").alias("shard"), (F.col("__place") - start).alias("slot"),
    )
