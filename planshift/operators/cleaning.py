"""Cell cleaning, imputation and best-effort casts; one projection each, never a loop of passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planshift.functions.expressions import coded, number_of
from planshift.functions.fixed_values import CELL_SENTINELS, MISSING_NUMERIC, MISSING_TEXT
from planshift.operators.columns import cells, split_by_type


def clean_cells(
    df: DataFrame, sentinels: Mapping[str, int] = CELL_SENTINELS, fill: int = 0, skip: Sequence[str] = ()
) -> DataFrame:
    """Replace whole cells: sentinels by their code, NULL and NaN by ``fill``.

    Text columns stay text (the codes are written as text) until ``auto_numeric``.
    Dates and timestamps have no numeric fill and pass through.
    """

    def cleaned(field: T.StructField):
        column = F.col(field.name)
        if field.name in skip:
            return column
        if isinstance(field.dataType, T.StringType):
            as_text = {key: str(code) for key, code in sentinels.items()}
            known = F.when(column.isin(*as_text), coded(column, as_text)).otherwise(column)
            return F.coalesce(known, F.lit(str(fill))).alias(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.coalesce(F.nanvl(column, F.lit(None)), F.lit(fill)).cast(field.dataType).alias(field.name)
        if isinstance(field.dataType, T.NumericType):
            return F.coalesce(column, F.lit(fill)).cast(field.dataType).alias(field.name)
        return column

    return df.select([cleaned(f) for f in df.schema.fields])


def fill_by_type(df: DataFrame, number=0, text: str = MISSING_TEXT, blank_is_missing: bool = False) -> DataFrame:
    """NULL becomes ``number`` or ``text`` by column type; a single blank too when asked."""
    numeric, strings = split_by_type(df)
    filled = df.na.fill(number, subset=numeric).na.fill(text, subset=strings)
    if blank_is_missing and strings:
        filled = filled.na.replace(" ", text, subset=strings)
    return filled


def fill_sentinel(df: DataFrame) -> DataFrame:
    """The far-off numeric sentinel instead of 0."""
    return fill_by_type(df, number=MISSING_NUMERIC)


def numeric_text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Text columns in which every known value is a decimal number; one pass over the data.

    NULL does not speak against a column; a column of NULLs only is numeric.
    """
    strings = [c for c in split_by_type(df)[1] if c not in skip]
    if not strings:
        return []
    other = {c: F.col(c).isNotNull() & number_of(F.col(c)).isNull() for c in strings}
    found = cells(df, other).filter("value").select("feature").distinct().collect()  # a row per column at most
    return [c for c in strings if c not in {row["feature"] for row in found}]


def cast_numeric(df: DataFrame, text_columns: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Doubles for all number-typed columns and for the listed text columns."""
    numeric = [c for c in split_by_type(df)[0] if c not in skip]

    def out(name: str):
        if name in text_columns:
            return number_of(F.col(name)).alias(name)
        return F.col(name).cast("double").alias(name) if name in numeric else F.col(name)

    return df.select([out(c) for c in df.columns])


def auto_numeric(df: DataFrame) -> DataFrame:
    """Cast each column that is numeric throughout; leave the others alone."""
    return cast_numeric(df, numeric_text_columns(df))
