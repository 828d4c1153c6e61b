"""Label job: which sales moved an account to a higher tier."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planshift.functions.expressions import moved_up, tier_rank, year_month
from planshift.functions.fixed_values import (
    ACTIVE_STATUSES,
    CHANNEL_CONTAINS,
    SUB_TASK,
    TASK_PREFIX,
    TIER_RANKS,
)
from planshift.operators.filters import day_range, eligible, text_matches
from planshift.operators.joins import period_pair


@dataclass(frozen=True)
class LabelSpec:
    current: str
    previous: str
    day_from: dt.date
    day_to: dt.date
    tier_ranks: Mapping[str, int] = field(default_factory=lambda: TIER_RANKS)
    statuses: Sequence[str] = ACTIVE_STATUSES
    channel_contains: str | None = CHANNEL_CONTAINS
    channel_prefix: str | None = None
    task_contains: str | None = None
    task_prefix: str | None = TASK_PREFIX
    sub_task: str = SUB_TASK


def tier_changes(snapshots: DataFrame, spec: LabelSpec) -> DataFrame:
    """Eligible accounts with tier before and after and the ``upgraded`` flag."""
    return _changes(period_pair(snapshots, spec.current, spec.previous), spec)


def _changes(pairs: DataFrame, spec: LabelSpec, *carry: str) -> DataFrame:
    ranks = tier_rank(F.col("tier_m0"), spec.tier_ranks), tier_rank(F.col("tier_m1"), spec.tier_ranks)
    return eligible(pairs, spec.statuses).select(
        "account_id",
        *carry,
        moved_up(*ranks).alias("upgraded"),
        F.col("tier_m0").alias("tier_to"),
        F.col("tier_m1").alias("tier_from"),
    )


def distinct_pairs(snapshots: DataFrame, spec: LabelSpec) -> DataFrame:
    """The distinct pairs of ``period_pair``, from one pass over the snapshots and one exchange by account.

    The rows of both periods of an account meet as sets, which are combined in the map tasks; an account that is
    listed twice in a period gives a pair for each of its different rows, as the join would.
    """
    held = [c for c in snapshots.columns if c not in ("account_id", "ym")]
    ym = F.col("ym")

    def rows_of(period: str) -> Column:
        return F.collect_set(F.when(ym == period, F.struct(*held)))

    both = snapshots.filter(ym.isin(spec.current, spec.previous) & F.col("account_id").isNotNull())
    sides = both.groupBy("account_id").agg(rows_of(spec.current).alias("_now"), rows_of(spec.previous).alias("_then"))
    pairs = sides.select("account_id", F.explode("_now").alias("_now"), "_then").select("account_id", "_now", F.explode("_then").alias("_then"))
    named = {"_now": "_m0", "_then": "_m1"}
    return pairs.select("account_id", *[F.col(f"{side}.{c}").alias(c + suffix) for side, suffix in named.items() for c in held])


def _wanted(spec: LabelSpec) -> Column:
    return (
        text_matches("channel", spec.channel_contains, spec.channel_prefix)
        & text_matches("task", spec.task_contains, spec.task_prefix)
        & (F.col("sub_task") == spec.sub_task)
    )


def matching_sales(sales: DataFrame, spec: LabelSpec) -> DataFrame:
    """Distinct sales of the window, channel and task.

    Only what the label needs is kept and copies are collapsed in the map tasks, so an
    account with very many sale lines reaches the join as few rows.
    """
    in_window = day_range(sales, "day", spec.day_from, spec.day_to).filter(_wanted(spec))
    return in_window.select("account_id", "account_number", "day", "product_mix").distinct()


def upgrade_sales(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """Sales of accounts that moved up."""
    upgrades = changes.filter(F.col("upgraded") == 1).drop("upgraded")
    return sales.join(upgrades, "account_id")


def build_labels(sales: DataFrame, snapshots: DataFrame, spec: LabelSpec) -> DataFrame:
    """One row per distinct upgrade sale with the tiers before and after.

    Snapshots are read once for both periods.  Sales arrive distinct and accounts are as a rule
    unique per period; ``distinct`` only guards snapshots that list an account with different
    rows, and works on the join's partitioning by account.
    """
    changes = _changes(distinct_pairs(snapshots, spec), spec)
    labelled = upgrade_sales(matching_sales(sales, spec), changes)
    return labelled.select(
        "account_id",
        "account_number",
        "day",
        year_month(F.col("day")).alias("year_month"),
        "tier_to",
        "tier_from",
        "product_mix",
    ).distinct()


@dataclass(frozen=True)
class Period:
    current: str
    previous: str
    day_from: dt.date
    day_to: dt.date


def build_labels_over(sales: DataFrame, snapshots: DataFrame, spec: LabelSpec, periods: Sequence[Period]) -> DataFrame:
    """The labels of several periods, told apart by ``period`` (the current one), by one job.

    ``spec`` gives everything but the periods.  Sales are read once and snapshots once per side,
    however many periods there are: each row is repeated only for the periods that it belongs
    to, and accounts meet their sales on (account, period).  Windows of sales may overlap.
    """
    if len({p.current for p in periods}) < len(periods):
        raise ValueError("a period is listed twice")

    def of(belongs) -> Column:
        """One row per period for which ``belongs`` holds."""
        named = F.array(*[F.when(belongs(p), F.lit(p.current)) for p in periods])
        return F.explode(F.filter(named, lambda name: name.isNotNull())).alias("period")

    day, ym = F.col("day"), F.col("ym")
    whole = replace(spec, day_from=min(p.day_from for p in periods), day_to=max(p.day_to for p in periods))
    in_reach = day_range(sales, "day", whole.day_from, whole.day_to).filter(_wanted(spec))
    sold = in_reach.select(
        "account_id", "account_number", "day", "product_mix", of(lambda p: (day >= p.day_from) & (day < p.day_to))
    ).distinct()

    def side(suffix: str, period_of) -> DataFrame:
        rows = snapshots.filter(ym.isin([period_of(p) for p in periods]))
        kept = [F.col(c).alias(c if c == "account_id" else c + suffix) for c in snapshots.columns if c != "ym"]
        return rows.select(*kept, of(lambda p: ym == period_of(p)))

    pairs = side("_m0", lambda p: p.current).join(side("_m1", lambda p: p.previous), ["account_id", "period"])
    upgrades = _changes(pairs, spec, "period").filter(F.col("upgraded") == 1).drop("upgraded")
    return sold.join(upgrades, ["account_id", "period"]).select(
        "period",
        "account_id",
        "account_number",
        "day",
        year_month(day).alias("year_month"),
        "tier_to",
        "tier_from",
        "product_mix",
    ).distinct()
