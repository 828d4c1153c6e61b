"""Column expressions.  All of them compile to built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from planshift.functions.fixed_values import TIER_RANKS, WOE_SMOOTHING

# Decimal numbers as text: sign, digits, fraction, exponent; blanks around them are fine.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def coded(value: Column, codes: Mapping, default=None) -> Column:
    """Look ``value`` up in a small constant mapping; anything else, NULL included, gets ``default``."""
    if not codes:
        return F.lit(default)
    expr = F
    for key, code in codes.items():
        expr = expr.when(value == key, F.lit(code))
    return expr.otherwise(F.lit(default))


def tier_rank(tier: Column, ranks: Mapping[str, int] = TIER_RANKS) -> Column:
    return coded(tier, ranks)


def moved_up(rank_now: Column, rank_before: Column) -> Column:
    """1 when the rank rose, else 0; an unknown rank on either side counts as 0."""
    return F.when(rank_now > rank_before, 1).otherwise(0)


def equals_flag(value: Column, wanted) -> Column:
    return F.when(value == wanted, 1).otherwise(0)


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyyMM")


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Date of numeric parts; parts that form no calendar day give NULL."""
    text = F.concat_ws(
        "-",
        F.lpad(year.cast("string"), 4, "0"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    )
    return F.try_to_date(text, "yyyy-MM-dd")


def as_date(value: Column) -> Column:
    """Best-effort date of a text, timestamp or date column."""
    return value.try_cast("date")


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(as_date(later), as_date(earlier))


def capped(value: Column, above: float, to: float) -> Column:
    """Values beyond ``above`` become ``to``, so 74.5 with (74, 75) gives 75."""
    return F.when(value > above, F.lit(to)).otherwise(value)


def tidy_text(value: Column) -> Column:
    """NULL and the single blank become ``NA``; the rest is upper-cased text."""
    text = value.cast("string")
    return F.upper(F.when(text == " ", "NA").otherwise(F.coalesce(text, F.lit("NA"))))


def smoothed_log_ratio(event: Column, non_event: Column, smoothing: float = WOE_SMOOTHING) -> Column:
    return F.log((event + smoothing) / (non_event + smoothing))


def percent(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; NULL for an empty whole."""
    return F.try_divide(part * F.lit(100.0), whole)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over the rows that have both; NULL where either is constant."""
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread)


def number_of(value: Column) -> Column:
    """Double of a text that is a plain decimal number, else NULL."""
    return F.when(value.rlike(NUMBER_TEXT), F.trim(value).try_cast("double"))


def hash_share(keys: Sequence[Column], seed: int) -> Column:
    """Uniform value in [0, 1) that depends on the key and the seed only."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    first_bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return first_bits / F.lit(4294967296.0)
