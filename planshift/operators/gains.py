"""Decile gains: counts, shares, running shares, lift and the Kolmogorov-Smirnov distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planshift.operators.ranking import assign_deciles, running_totals


def decile_counts(
    ranked: DataFrame, score: str, target: str, group_by: Sequence[str] = ()
) -> DataFrame:
    """Rows, targets, non-targets and score sum per decile (and group)."""
    return ranked.groupBy(*group_by, "decile").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(target) == 1).alias("targets"),
        F.count_if(F.col(target) == 0).alias("non_targets"),
        F.sum(score).alias("score_sum"),
    )


def running_shares(counts: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Share and running share of targets and non-targets; ten rows per group by now."""
    whole = Window.partitionBy(*group_by)
    so_far = whole.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)

    def share(column: str):
        return F.try_divide(F.col(column), F.sum(column).over(whole))

    def running(column: str):
        return F.try_divide(F.sum(column).over(so_far), F.sum(column).over(whole))

    return counts.select(
        "*",
        share("targets").alias("target_share"),
        share("non_targets").alias("non_target_share"),
        running("targets").alias("target_running"),
        running("non_targets").alias("non_target_running"),
    )


def with_lift(shares: DataFrame, bins: int = 10) -> DataFrame:
    """Running target share over the share of rows that far down."""
    return shares.withColumn("lift", F.col("target_running") / (F.col("decile") / F.lit(float(bins))))


def with_distance(shares: DataFrame) -> DataFrame:
    gap = F.abs(F.col("target_running") - F.col("non_target_running"))
    return shares.withColumn("ks_at", gap * 100)


def gains_table(
    scored: DataFrame,
    score: str,
    target: str,
    keys: Sequence[str],
    group_by: Sequence[str] = (),
    bins: int = 10,
    pieces: int | None = None,
) -> DataFrame:
    """The full table, one row per group and decile; decile 1 holds the highest scores."""
    needed = scored.select(*group_by, *keys, score, target)
    ranked = assign_deciles(needed, score, keys, group_by, bins, pieces)
    counts = decile_counts(ranked, score, target, group_by)
    return with_distance(with_lift(running_shares(counts, group_by), bins))


def ks_distance(gains: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Largest gap between the running shares, in percent, per group."""
    return gains.groupBy(*group_by).agg(F.max("ks_at").alias("ks"))


def area_under_curve(scored: DataFrame, score: str, target: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve (``auc``) per group; equal scores count half.

    Rows of one score are counted together first, so a score shared by a third of the rows
    is a single row of the ordered part.
    """
    counted = scored.groupBy(*group_by, score).agg(
        F.count_if(F.col(target) == 1).alias("_hits"), F.count_if(F.col(target) == 0).alias("_others")
    )
    ordered = running_totals(counted, [F.col(score)], "_others", group_by)
    beaten = F.col("_hits") * (F.col("before") + F.col("_others") / 2)
    # as doubles: the product of two large counts goes beyond 64 bits
    pairs = F.sum("_hits").cast("double") * F.max("whole").cast("double")
    return ordered.groupBy(*group_by).agg(F.try_divide(F.sum(beaten), pairs).alias("auc"))


def class_scores(
    scored: DataFrame, keys: Sequence[str], actual: str, score_columns: dict, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per record and class: class, its score, and whether it is the actual class."""
    one_vs_rest = F.array(
        *[
            F.struct(
                F.lit(value).alias("class"),
                F.col(column).alias("score"),
                F.when(F.col(actual) == value, 1).otherwise(0).alias("is_class"),
            )
            for value, column in score_columns.items()
        ]
    )
    return scored.select(*carry, *keys, F.inline(one_vs_rest))
