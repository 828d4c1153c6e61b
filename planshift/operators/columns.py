"""Projections: which columns to keep, under which name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planshift.functions.expressions import tidy_text
from planshift.functions.fixed_values import EXCLUDED_COLUMNS, FEATURE_SETS


def project(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Select ``{column: new name}`` in the given order."""
    return df.select([F.col(c).alias(new) for c, new in names.items()])


def all_but(df: DataFrame, pattern: str) -> DataFrame:
    """Every column whose whole name does not match the regular expression."""
    return df.select(df.colRegex(f"`(?!(?:{pattern})$).+`"))


def rename_clashes(right: DataFrame, left: DataFrame, suffix: str) -> DataFrame:
    """Rename columns of ``right`` that ``left`` also has, so both sides survive a join."""
    taken = set(left.columns)
    return right.select([F.col(c).alias(c + suffix if c in taken else c) for c in right.columns])


def suffix_columns(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select([F.col(c).alias(c if c in keep else c + suffix) for c in df.columns])


def split_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric columns, text columns) by declared type."""
    fields = df.schema.fields
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    return numeric, text


def drop_features(df: DataFrame, names: Iterable[str] = EXCLUDED_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """Drop the listed columns, never those in ``keep`` (label, keys, weights)."""
    return df.drop(*[n for n in names if n not in keep])


def feature_set(name: str) -> list[str]:
    return list(FEATURE_SETS[name])


def model_matrix(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, *features, label)


def cells(df: DataFrame, values: Mapping[str, Column], carry: Sequence[str] = ()) -> DataFrame:
    """One row (``feature``, ``value``) per row and named expression, beside the carried columns.

    Grouped by ``feature`` it profiles any number of columns with one small aggregation: the
    plan does not grow with the table's width, and the map tasks send a row per feature.
    """
    names = F.array(*[F.lit(n) for n in values])
    long = df.select(*carry, F.posexplode(F.array(*values.values())).alias("_place", "value"))
    return long.select(*carry, F.element_at(names, F.col("_place") + 1).alias("feature"), "value")


def known_doubles(columns: Sequence[str]) -> dict[str, Column]:
    """Columns as doubles, NaN taken as missing."""
    return {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}


def column_listing(df: DataFrame) -> DataFrame:
    """Position, name and type of each column, with the row count of the frame."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
            )
            for i, f in enumerate(df.schema.fields, start=1)
        ]
    )
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("rows", F.inline(entries))


def split_numeric_text(
    df: DataFrame, excluded: Iterable[str], label: str, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Numeric and text halves of a frame, filled and tidied, each with keys and label.

    Text is upper-cased, NULL and blank become ``NA``; numeric NULL becomes 0.
    """
    skip = set(excluded) | {label} | set(keys)
    numeric, text = ([c for c in cols if c not in skip] for cols in split_by_type(df))
    numeric_df = df.select(*keys, *numeric, label).na.fill(0, subset=numeric)
    text_df = df.select(*keys, *[tidy_text(F.col(c)).alias(c) for c in text], label)
    return numeric_df, text_df, numeric, text
