"""Bounded samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, held_out: Column, per_class: int
) -> DataFrame:
    """``__text`` and ``__label`` of at most ``per_class`` rows of each of the labels 0 and 1, none of them held out.

    Keys go in the order of a hash. The bound holds for the rows: a key that is repeated in either table gives the rows
    of its different texts and labels as far as the bound goes; copies of a row count once. Texts are read for the chosen
    rows alone.
    """
    known = labels.filter(~held_out & F.col(label).isin(0, 1)).select(
        F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")
    ).distinct()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    same = F.md5(F.coalesce(F.col("__text"), F.lit("")))

    def first(found: DataFrame, *order: Column | str) -> DataFrame:
        """At most ``per_class`` rows of each label: bounded, so that it may be broadcast."""
        chosen = [found.filter(F.col("__label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
        return F.broadcast(chosen[0].union(chosen[1]))

    order = F.md5(F.col("__key").cast("string"))
    keys = first(known.join(rows.select("__key").distinct(), "__key", "left_semi"), order, "__key")
    found = rows.join(keys, "__key").select("__key", "__label", same.alias("__same")).distinct()
    chosen = first(found, order, "__key", "__same")
    texts = rows.withColumn("__same", same).join(chosen, ["__key", "__same"])
    return texts.dropDuplicates(["__key", "__same", "__label"]).select("__text", "__label")
