"""Row filters with the exact NULL behaviour each job needs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planshift.functions.fixed_values import ACTIVE_STATUSES


def eligible(pair: DataFrame, statuses: Sequence[str] = ACTIVE_STATUSES) -> DataFrame:
    """Residential video accounts, active with products in both periods.

    A NULL courtesy flag is not eligible: ``<>`` keeps known values only.
    """
    now_ok = (
        F.col("status_m0").isin(*statuses)
        & (F.col("video_units_m0") == 1)
        & (F.col("product_count_m0") > 0)
        & (F.col("residential_m0") == 1)
        & (F.col("disconnected_m0") == 0)
        & (F.col("courtesy_m0") != 1)
    )
    before_ok = (
        F.col("status_m1").isin(*statuses)
        & (F.col("video_units_m1") == 1)
        & (F.col("product_count_m1") > 0)
    )
    return pair.filter(now_ok & before_ok)


def day_range(df: DataFrame, column: str, start: dt.date, end: dt.date) -> DataFrame:
    """Half-open: ``start`` is in, ``end`` is out."""
    return df.filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def text_matches(column: str, contains: str | None = None, prefix: str | None = None) -> Column:
    """Case-sensitive ``LIKE '%x%'`` / ``LIKE 'x%'``."""
    test = F.lit(True)
    if contains is not None:
        test = test & F.col(column).contains(contains)
    if prefix is not None:
        test = test & F.col(column).startswith(prefix)
    return test


def drop_class(df: DataFrame, column: str, value) -> DataFrame:
    """Remove one class; rows with an unknown class stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def missed_positives(
    scored: DataFrame, predicted: str = "pred", actual: str = "target", code: str = "prior_code", not_code: int = 2
) -> DataFrame:
    """Actual positives predicted negative, outside the prior class ``not_code``."""
    return scored.filter((F.col(predicted) == 0) & (F.col(actual) == 1) & (F.col(code) != not_code))
