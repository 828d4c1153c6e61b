"""Profile job: everything one looks at before modelling, from one pass over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.functions.expressions import percent
from planshift.functions.fixed_values import CORRELATION_FLOOR
from planshift.operators.columns import split_by_type
from planshift.operators.encoding import evidence_of_shares, information_value, shares_of_counts
from planshift.operators.profile import QUARTILES, edges_of, nulls_of, numbers_of, profile_state
from planshift.operators.ranking import exact_quantiles
from planshift.sources.tables import pinned


def profile_report(
    df: DataFrame,
    label: str,
    classes: Sequence,
    keys: Sequence[str] = (),
    numeric: Sequence[str] | None = None,
    quantiles: str = "approx",
) -> dict[str, DataFrame]:
    """Tables by name.  Give the development columns as ``numeric`` to profile a later month alike.

    ``df`` is read once, here: its state (one row per column and text value) is stored, and all tables read
    that.  ``quantiles="exact"`` reads ``df`` a second time, for the values in the brackets that the state gives.
    """
    numbers, texts = split_by_type(df)
    skip = {label, *keys}
    numbers = [c for c in (numeric or numbers) if c not in skip]
    texts = [c for c in texts if c not in skip]
    state = pinned(profile_state(df, numbers, texts, label, classes))
    exact = None
    if quantiles == "exact" and numbers:
        edges = edges_of(state.filter(F.col("feature").isin(numbers)), "edges")
        exact = exact_quantiles(df, numbers, QUARTILES, edges)
    of_label = state.filter((F.col("feature") == label) & F.col("text").isNotNull())
    shares = of_label.select(F.col("text").cast(df.schema[label].dataType).alias(label), F.col("rows").alias("n"))
    correlations = state.filter(F.col("feature").isin(numbers)).select("feature", "correlation")
    tables = {
        "class_share": shares.withColumn("share_pct", percent(F.col("n"), shares.agg(F.sum("n")).scalar())),
        "nulls": nulls_of(state),
        "numeric": numbers_of(state, numbers, exact),
        "correlation": correlations.filter(F.col("correlation") > CORRELATION_FLOOR),
    }
    if texts:
        of_texts = state.filter(F.col("feature").isin(texts))
        counts = of_texts.filter(F.col("text").isNotNull()).select(
            F.col("feature").alias("variable"), F.col("text").alias("value"), F.col("rows").alias("n"),
            *[f"n_{i}" for i in range(len(classes))],
        )
        evidence = evidence_of_shares(shares_of_counts(counts, classes))
        tables["missing_text"] = nulls_of(of_texts).drop("nulls")
        tables["evidence"] = evidence
        tables["information_value"] = information_value(evidence)
    return tables
