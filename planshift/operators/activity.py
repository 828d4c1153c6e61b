"""Daily activity features: channel counters, trailing totals, days since the last visit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("web", "mobile")


def daily_counters(
    events: DataFrame, key: str, day: str, channel: str, kind: str, kinds: Sequence[str]
) -> DataFrame:
    """One row per (key, day): count of each kind per channel and their total.

    Counting happens in the map tasks first, so a key that owns a third of the events sends
    one row per day and task.
    """
    counters = [
        F.count_if((F.col(channel) == c) & (F.col(kind) == k)).alias(f"{c}_{k}")
        for c in CHANNELS
        for k in kinds
    ]
    daily = events.groupBy(key, day).agg(*counters)
    totals = [sum((F.col(f"{c}_{k}") for c in CHANNELS[1:]), F.col(f"{CHANNELS[0]}_{k}")).alias(f"total_{k}") for k in kinds]
    return daily.select("*", *totals)


def trailing_totals(
    daily: DataFrame, key: str, day: str, metrics: Sequence[str], windows: Sequence[int]
) -> DataFrame:
    """Add ``<metric>_l<k>d``: sum over the ``k`` days that end with the row's day.

    The frame holds one row per key and day, so a window never exceeds the days on record.
    """
    number = F.unix_date(F.col(day))
    spans = {k: Window.partitionBy(key).orderBy(number).rangeBetween(-(k - 1), 0) for k in windows}
    sums = [F.sum(m).over(spans[k]).alias(f"{m}_l{k}d") for m in metrics for k in windows]
    return daily.select("*", *sums)


def days_since_last(daily: DataFrame, key: str, day: str, name: str = "days_since_last_visit") -> DataFrame:
    """Days since the previous row of the key; NULL on its first day."""
    before = F.lag(day).over(Window.partitionBy(key).orderBy(day))
    return daily.withColumn(name, F.datediff(F.col(day), before))


def page_flags(events: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """0/1 per kind and key: did it occur at all."""
    flags = [F.max(F.when(F.col(kind) == k, 1).otherwise(0)).alias(f"{k}_flag") for k in kinds]
    return events.groupBy(*keys).agg(*flags)
