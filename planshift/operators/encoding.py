"""Category encodings: weight of evidence, information value, label codes, one-vs-rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.functions.expressions import smoothed_log_ratio, tidy_text
from planshift.operators.columns import cells
from planshift.operators.joins import hot_values, lookup_join
from planshift.operators.ranking import global_rank
from planshift.sources.tables import pinned

# All lookups that travel to every executor in one call stay below this size together; the others are shuffled.
BROADCAST_BYTES = 32 << 20


def one_vs_rest(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """A 0/1 column ``is_<class>`` per listed class."""
    flags = [F.when(F.col(label) == c, 1).otherwise(0).alias(f"is_{c}") for c in classes]
    return df.select("*", *flags)


def category_counts(df: DataFrame, variables: Sequence[str], label: str, classes: Sequence) -> DataFrame:
    """Rows and rows per class of each (variable, value); one shuffle for all variables.

    Unknown values (NULL) are left out, as grouping on them does in data frames.
    """
    texts = {v: F.col(v).cast("string") for v in variables}
    long = cells(df, texts, [label]).withColumnRenamed("feature", "variable").filter(F.col("value").isNotNull())
    per_class = [F.count_if(F.col(label) == c).alias(f"n_{i}") for i, c in enumerate(classes)]
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"), *per_class)


def category_shares(df: DataFrame, variables: Sequence[str], label: str, classes: Sequence) -> DataFrame:
    """Per (variable, value, class): counts and the value's share of events and of non-events."""
    return shares_of_counts(category_counts(df, variables, label, classes), classes)


def shares_of_counts(counts: DataFrame, classes: Sequence) -> DataFrame:
    """The shares of ``category_shares`` from the counts of ``category_counts``."""
    totals = counts.groupBy("variable").agg(
        F.sum("n").alias("all_n"),
        *[F.sum(f"n_{i}").alias(f"all_{i}") for i in range(len(classes))],
    )
    # one row per variable: bounded by the number of columns
    joined = counts.join(F.broadcast(totals), "variable")
    entries = []
    for i, c in enumerate(classes):
        event, others = F.col(f"n_{i}"), F.col("n") - F.col(f"n_{i}")
        all_event, all_others = F.col(f"all_{i}"), F.col("all_n") - F.col(f"all_{i}")
        entries.append(
            F.struct(
                F.lit(c).alias("class"),
                event.alias("events"),
                others.alias("non_events"),
                F.coalesce(F.try_divide(event, all_event), F.lit(0.0)).alias("event_share"),
                F.coalesce(F.try_divide(others, all_others), F.lit(0.0)).alias("non_event_share"),
            )
        )
    return joined.select("variable", "value", F.inline(F.array(*entries)))


def weight_of_evidence(df: DataFrame, variables: Sequence[str], label: str, classes: Sequence) -> DataFrame:
    """WOE and IV part of each value, averaged over the one-vs-rest tables of ``classes``.

    Give a binary label as the single class ``[1]``: over ``[0, 1]`` the two tables mirror
    each other and the average carries no evidence.
    """
    return evidence_of_shares(category_shares(df, variables, label, classes))


def evidence_of_shares(shares: DataFrame) -> DataFrame:
    """WOE and IV part of each value from the shares of ``category_shares``."""
    means = shares.groupBy("variable", "value").agg(
        F.avg("event_share").alias("event_pct"), F.avg("non_event_share").alias("non_event_pct")
    )
    woe = means.withColumn("woe", smoothed_log_ratio(F.col("event_pct"), F.col("non_event_pct")))
    return woe.withColumn("iv", (F.col("event_pct") - F.col("non_event_pct")) * F.col("woe"))


def information_value(woe: DataFrame) -> DataFrame:
    """IV per variable, highest first."""
    table = woe.groupBy("variable").agg(F.sum("iv").alias("iv"))
    return table.orderBy(F.col("iv").desc(), F.col("variable"))


def attach_lookup(
    df: DataFrame, table: DataFrame, variables: Sequence[str], result: str, suffix: str, text=None
) -> DataFrame:
    """Add ``<variable><suffix>`` from a (variable, value, result) table; no match gives NULL.

    The table is computed once and its bytes are measured per variable.  The smallest lookups
    are broadcast as long as all of them stay below ``BROADCAST_BYTES``; the others are
    shuffled, and values that fill much of a column are spread over several tasks.
    """
    table = pinned(table.select("variable", "value", result))
    # text, result and the overhead of a hashed row
    held = F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 64).alias("held")
    sizes = table.filter(F.col("variable").isin(list(variables))).groupBy("variable").agg(held).collect()  # a row per variable
    long, total = [], 0
    for size in sorted(sizes, key=lambda s: (s["held"], s["variable"])):
        total += size["held"]
        if total > BROADCAST_BYTES:
            long.append(size["variable"])
    text = text or (lambda column: column.cast("string"))
    hot = hot_values(df.select(*[text(F.col(v)).alias(v) for v in long]), *long) if long else {}
    for variable in variables:
        one = table.filter(F.col("variable") == variable).select(
            F.col("value").alias("_value"), F.col(result).alias(variable + suffix)
        )
        keyed = df.withColumn("_value", text(F.col(variable)))
        if variable in long:
            df = lookup_join(keyed, one, ["_value"], "left", "_value", hot[variable]).drop("_value")
        else:
            df = keyed.join(F.broadcast(one), "_value", "left").drop("_value")
    return df


def apply_woe(df: DataFrame, woe: DataFrame, variables: Sequence[str]) -> DataFrame:
    return attach_lookup(df, woe, variables, "woe", "_WOE")


def label_codes(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, value, code): values in text order, coded from 0 within each variable.

    Distinct values only are ranked, by range partitions, so no list of values is ever
    held in one place.
    """
    texts = {v: tidy_text(F.col(v)) for v in variables}
    distinct = cells(df, texts).withColumnRenamed("feature", "variable").distinct()
    ranked = global_rank(distinct, [F.col("value")], ["variable"])
    return ranked.select("variable", "value", (F.col("rank") - 1).alias("code"))


def apply_label_codes(df: DataFrame, codes: DataFrame, variables: Sequence[str]) -> DataFrame:
    return attach_lookup(df, codes, variables, "code", "_LE", tidy_text)
