"""Dataset job: labelled sales with recent visits, daily features, page flags and attributes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.functions.expressions import date_from_parts
from planshift.operators.columns import rename_clashes, suffix_columns
from planshift.operators.joins import drop_copies, enrich, hot_values, join_daily, join_recent
from planshift.sources.tables import dated_partitions


@dataclass(frozen=True)
class DatasetSpec:
    year: int
    first_month: int
    after_day: int = 0
    low: int = 0
    high: int = 2
    latest_only: bool = False
    spread_hot_accounts: bool = False


def wanted_days(labels: DataFrame, spec: DatasetSpec) -> DataFrame:
    """The days (``_day``) on which a visit before some sale may fall, within the wanted parts of the year.

    At most one row per day of the year, whatever the data.
    """
    days = F.explode(F.sequence(F.date_sub("day", spec.high), F.date_sub("day", spec.low)))
    reached = labels.select("day").distinct().select(days.alias("_day"))
    day = F.col("_day")
    inside = (F.year(day) == spec.year) & (F.month(day) >= spec.first_month) & (F.dayofmonth(day) > spec.after_day)
    return reached.filter(inside).distinct()


def daily_rows(daily: DataFrame, spec: DatasetSpec, day: str = "daily_day", days: DataFrame | None = None) -> DataFrame:
    """The wanted partitions of the daily table with one real date instead of its parts.

    With ``days`` only those days are read: the date is made of partition columns alone, so the
    semi join prunes partitions while the job runs, before any row of them is read.
    """
    wanted = dated_partitions(daily, spec.year, spec.first_month, spec.after_day)
    parts = (F.col("year"), F.col("month"), F.col("date"))
    rows = wanted.withColumn(day, date_from_parts(*parts)).drop("year", "month", "date")
    if days is None:
        return rows
    # at most 366 rows
    return rows.join(F.broadcast(days), rows[day] == days["_day"], "left_semi")


def build_dataset(
    labels: DataFrame,
    visits: DataFrame,
    daily: DataFrame,
    flags_desktop: DataFrame,
    flags_mobile: DataFrame,
    attributes: DataFrame,
    spec: DatasetSpec,
) -> DataFrame:
    """One row per sale and visit day.

    ``labels`` have (account_id, day, ...), ``visits`` (account_id, visit_day, ...), ``daily``
    (account_id, year, month, date, ...), the flag tables (account_id, visit_day, flags) and
    ``attributes`` (account_id, ...).

    Attributes are joined to the labels, the narrowest rows there are, so that the wide rows need
    not move by account once more.  From then on everything goes by (account, day): one exchange
    per source serves both its join and the removal of copies.  Of the daily table only the days
    that the labels reach are read, and copies of a daily row are dropped after the join, among the rows that
    matched.  Busy accounts are left to adaptive skew handling; with ``spread_hot_accounts`` they are found
    by one more pass over the labels and spread by hand.
    """
    hot = hot_values(labels, "account_id")["account_id"] if spec.spread_hot_accounts else {}
    held = {c: f"_attribute_{c}" for c in attributes.columns if c != "account_id"}
    known = enrich(labels, (attributes.withColumnsRenamed(held), ["account_id"], hot))
    keys = ["account_id", "visit_day"]
    recent = drop_copies(
        join_recent(known, visits, "account_id", "day", "visit_day", spec.low, spec.high, latest_only=spec.latest_only),
        keys,
    )
    features = daily_rows(daily, spec, days=wanted_days(labels, spec)).withColumnRenamed("account_id", "_key")
    features = rename_clashes(features, recent, "_daily").withColumnRenamed("_key", "account_id")
    base = drop_copies(join_daily(recent, features, "account_id", "visit_day", "daily_day"), keys)
    flagged = enrich(
        base,
        (flags_desktop, keys, {}),  # (account, day): a busy account is spread over its days
        (suffix_columns(flags_mobile, "_m", keep=keys), keys, {}),
    )
    rest = [c for c in flagged.columns if c not in held and c not in held.values()]
    return flagged.select(*rest, *[F.col(own).alias(c) for c, own in held.items()])
