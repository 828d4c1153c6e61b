"""Data profiles.  Each is one aggregation over all asked columns, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planshift.functions.expressions import correlation, percent
from planshift.operators.columns import cells, known_doubles, split_by_type
from planshift.operators.ranking import SKETCH_PARTS, bracket_edges, edge_sketch, exact_quantiles
from planshift.sources.tables import pinned

QUARTILES = (0.25, 0.5, 0.75)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per known value, most frequent first."""
    known = df.filter(F.col(column).isNotNull())
    counts = known.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(column))


def class_share(df: DataFrame, column: str) -> DataFrame:
    """Count and percent per known class."""
    known = df.filter(F.col(column).isNotNull())
    counts = known.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share_pct", percent(F.col("n"), total))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, nulls, missing_pct) for each column."""
    known = {c: F.col(c).isNull() for c in (columns or df.columns)}
    nulls = F.count_if(F.col("value"))
    return cells(df, known).groupBy("feature").agg(
        nulls.alias("nulls"), percent(nulls, F.count(F.lit(1))).alias("missing_pct")
    )


def columns_with_nulls(df: DataFrame) -> DataFrame:
    return null_counts(df).filter(F.col("nulls") > 0)


def missing_text(df: DataFrame, above: float | None = None) -> DataFrame:
    """Missing percent of each text column."""
    table = null_counts(df, split_by_type(df)[1]).select("feature", "missing_pct")
    return table if above is None else table.filter(F.col("missing_pct") > above)


def edges_of(table: DataFrame, sketch: str) -> dict[str, list[float]]:
    """Brackets of the quartiles by column, from a table with one row (``feature``, ``n``, sketch) per column."""
    rows = table.select("feature", "n", F.col(sketch).alias("sketch")).collect()
    return {r["feature"]: bracket_edges(r["n"], r["sketch"], len(QUARTILES)) for r in rows}


def numeric_profile(df: DataFrame, columns: Sequence[str], quantiles: str = "approx") -> DataFrame:
    """Count, mean, std, min, quartiles, max, range and missing percent per column.

    Quartiles come from one-pass sketches (accuracy 1/10000 of the rank); ``quantiles="exact"``
    interpolates between order statistics, at the price of a second pass over all values.
    """
    columns = list(columns)
    value, sketch = F.col("value"), quantiles == "approx"
    names = [f"q{round(p * 100):02d}" for p in QUARTILES]
    table = cells(df, known_doubles(columns)).groupBy("feature").agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        (F.max(value) - F.min(value)).alias("max_min"),
        percent(F.count_if(value.isNull()), F.count(F.lit(1))).alias("missing_pct"),
        (F.percentile_approx(value, list(QUARTILES)) if sketch else edge_sketch(value, QUARTILES)).alias("_q"),
    )
    if sketch:
        table = table.withColumns({name: F.col("_q")[i] for i, name in enumerate(names)})
    else:
        table = pinned(table)  # one row per column, as are the edges and the quantiles
        edges = edges_of(table, "_q")
        table = table.join(exact_quantiles(df, columns, QUARTILES, edges), "feature", "left")
    return table.select("feature", "n", "mean", "std", "min", *names, "max", "max_min", "missing_pct")


def profile_state(df: DataFrame, numbers: Sequence[str], texts: Sequence[str], label: str, classes: Sequence) -> DataFrame:
    """All that a report needs of every column, by one aggregation over one pass.

    One row (``feature``, ``text``) per column, and per value of the text columns and of the label.  The state
    of a row holds the counts of rows, of NULLs and of each class, moments, extremes, the co-moment with the label
    and a sketch of the quantiles; all of it merges, so map tasks send one row per column or value.
    """
    numbers, texts = list(numbers), list(texts)
    known, nothing = known_doubles(numbers), F.lit(None)

    def cell(c: str) -> Column:
        number = known[c] if c in known else nothing.cast("double")
        raw = F.col(c).cast("double") if c in known else nothing.cast("double")
        text = F.col(c).cast("string") if c in texts or c == label else nothing.cast("string")
        return F.struct(number.alias("number"), raw.alias("raw"), text.alias("text"), F.col(c).isNull().alias("missing"))

    goal = df.withColumns({"_goal": F.col(label).try_cast("double"), "_class": F.col(label)})
    long = cells(goal, {c: cell(c) for c in df.columns}, ["_goal", "_class"])
    number = F.col("value.number")
    return long.groupBy("feature", F.col("value.text").alias("text")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("value.missing")).alias("nulls"),
        F.count(number).alias("n"),
        F.avg(number).alias("mean"),
        F.stddev_samp(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        correlation(F.col("value.raw"), F.col("_goal")).alias("correlation"),
        F.percentile_approx(number, list(QUARTILES), SKETCH_PARTS).alias("quartiles"),
        edge_sketch(number, QUARTILES).alias("edges"),
        *[F.count_if(F.col("_class") == c).alias(f"n_{i}") for i, c in enumerate(classes)],
    )


def nulls_of(state: DataFrame) -> DataFrame:
    """(feature, nulls, missing_pct) from the state."""
    sums = state.groupBy("feature").agg(F.sum("nulls").alias("nulls"), F.sum("rows").alias("rows"))
    return sums.select("feature", "nulls", percent(F.col("nulls"), F.col("rows")).alias("missing_pct"))


def numbers_of(state: DataFrame, numbers: Sequence[str], exact: DataFrame | None = None) -> DataFrame:
    """The table of ``numeric_profile`` from the state; quartiles from ``exact`` where given."""
    names = [f"q{round(p * 100):02d}" for p in QUARTILES]
    table = state.filter(F.col("feature").isin(list(numbers))).withColumns(
        {
            "max_min": F.col("max") - F.col("min"),
            "missing_pct": percent(F.col("rows") - F.col("n"), F.col("rows")),
        }
    )
    if exact is None:
        table = table.withColumns({name: F.col("quartiles")[i] for i, name in enumerate(names)})
    else:
        table = table.join(exact, "feature", "left")  # both sides hold one row per column
    return table.select("feature", "n", "mean", "std", "min", *names, "max", "max_min", "missing_pct")


def mostly_missing(profile: DataFrame, above: float = 50.0) -> DataFrame:
    return profile.filter(F.col("missing_pct") > above)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the value range, the last one closed; empty bins are listed."""
    value = F.col(column).cast("double")
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    low, high = edges.select("lo").scalar(), edges.select("hi").scalar()
    spread = F.when(low == high, 0.5).otherwise(0.0)  # one value only: a range of 1 around it
    with_range = df.select(value.alias("v"), (low - spread).alias("lo"), (high + spread).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)) + 1
    # "least" passes over NULL, so a missing value has to be kept out of the bins
    placed = with_range.select("lo", width.alias("w"), F.when(F.col("v").isNotNull(), place).alias("bin"))
    entries = [
        F.struct(
            F.lit(b).alias("bin"),
            (F.max("lo") + (b - 1) * F.max("w")).alias("bin_from"),
            F.count_if(F.col("bin") == b).alias("n"),
        )
        for b in range(1, bins + 1)
    ]
    return placed.agg(F.array(*entries).alias("_rows")).select(F.inline("_rows"))


def target_correlation(df: DataFrame, columns: Sequence[str], target: str, floor: float | None = None) -> DataFrame:
    """Pearson correlation of each column with the target, optionally only those above ``floor``."""
    doubles = {c: F.col(c).cast("double") for c in columns}
    long = cells(df.withColumn("_goal", F.col(target).cast("double")), doubles, ["_goal"])
    table = long.groupBy("feature").agg(correlation(F.col("value"), F.col("_goal")).alias("correlation"))
    return table if floor is None else table.filter(F.col("correlation") > floor)


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows of a projection; equal rows meet in the map tasks before they are shuffled."""
    return (df.select(*columns) if columns else df).dropDuplicates()
