"""Preparation job: one definition for development and out-of-time tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.functions.expressions import capped, coded, equals_flag
from planshift.functions.fixed_values import (
    CELL_SENTINELS,
    POSITIVE_TIER,
    PRIOR_TIER_CODES,
    PRIOR_TIER_DEFAULT,
    PRODUCT_MIX_CODES,
    PRODUCT_MIX_DEFAULT,
    RARE_TIER,
    TENURE_CAP_AT,
    TENURE_CAP_TO,
)
from planshift.operators.cleaning import cast_numeric, clean_cells, numeric_text_columns
from planshift.operators.columns import model_matrix
from planshift.operators.filters import drop_class


@dataclass(frozen=True)
class PrepSpec:
    """What to derive, clean and cap.  ``numeric_text`` is pinned by ``fit_prep`` on development data."""

    class_column: str = "tier_to"
    positive: str = POSITIVE_TIER
    rare: str | None = RARE_TIER
    class_codes: Mapping[str, int] | None = None  # given: multi-class label instead of 0/1
    prior_column: str = "tier_from"
    prior_codes: Mapping[str, int] = field(default_factory=lambda: PRIOR_TIER_CODES)
    prior_default: int = PRIOR_TIER_DEFAULT
    prior_name: str = "prev_video_tier_name_enc"
    mix_column: str = "product_mix"
    mix_codes: Mapping[str, int] = field(default_factory=lambda: PRODUCT_MIX_CODES)
    mix_default: int = PRODUCT_MIX_DEFAULT
    mix_name: str = "productmix"
    cap_column: str = "tenure_by_account"
    cap_above: float = TENURE_CAP_AT
    cap_to: float = TENURE_CAP_TO
    label: str = "target"
    keys: Sequence[str] = ()
    sentinels: Mapping[str, int] = field(default_factory=lambda: CELL_SENTINELS)
    numeric_text: Sequence[str] | None = None


def _derived(df: DataFrame, spec: PrepSpec) -> DataFrame:
    """Label and codes from the raw text, then cleaned cells, then the cap.

    With a class list in ``class_codes`` the rare class has a code and stays.
    """
    if spec.class_codes is None:
        kept = drop_class(df, spec.class_column, spec.rare) if spec.rare is not None else df
        label = equals_flag(F.col(spec.class_column), spec.positive)
    else:
        kept, label = df, coded(F.col(spec.class_column), spec.class_codes)
    coded_frame = kept.withColumns(
        {
            spec.label: label.cast("int"),
            spec.prior_name: coded(F.col(spec.prior_column), spec.prior_codes, spec.prior_default),
            spec.mix_name: coded(F.col(spec.mix_column), spec.mix_codes, spec.mix_default),
        }
    )
    cleaned = clean_cells(coded_frame, spec.sentinels, skip=[*spec.keys, spec.label])
    if spec.cap_column not in cleaned.columns:
        return cleaned
    return cleaned.withColumn(
        spec.cap_column, capped(F.col(spec.cap_column).cast("double"), spec.cap_above, spec.cap_to)
    )


def fit_prep(development: DataFrame, spec: PrepSpec) -> PrepSpec:
    """Pin which text columns count as numeric, from the development table (one pass)."""
    return replace(spec, numeric_text=tuple(numeric_text_columns(_derived(development, spec), spec.keys)))


def prepare(df: DataFrame, spec: PrepSpec) -> DataFrame:
    """Apply the preparation: numbers come out as double, the label as int, keys untouched."""
    if spec.numeric_text is None:
        spec = fit_prep(df, spec)
    return cast_numeric(_derived(df, spec), spec.numeric_text, skip=[*spec.keys, spec.label])


def training_matrix(prepared: DataFrame, features: Sequence[str], spec: PrepSpec, distinct: bool = True) -> DataFrame:
    """Named features, label and keys.

    ``distinct`` keeps one row per combination of features and label, as usual for such
    tables; its keys are the smallest of the collapsed rows.  Equal rows meet in the map
    tasks, so a combination shared by a third of the rows is not shuffled row by row.
    """
    matrix = model_matrix(prepared, features, spec.label, spec.keys)
    if not distinct:
        return matrix
    columns = [*features, spec.label]
    if not spec.keys:
        return matrix.dropDuplicates()
    collapsed = matrix.groupBy(*columns).agg(F.min(F.struct(*spec.keys)).alias("_keys"))
    return collapsed.select("_keys.*", *columns)
