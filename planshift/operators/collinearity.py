"""Variance inflation: one distributed Gram matrix, everything else on that small matrix."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.functions.fixed_values import VIF_LIMIT


def gram_matrix(df: DataFrame, columns: Sequence[str], centred: bool = False) -> np.ndarray:
    """X'X of the columns (p x p), optionally around the column means.

    Every task adds its rows' products to one p x p matrix; only those matrices are merged.
    A missing or non-finite value adds nothing.
    """
    columns = list(columns)
    finite = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns}
    known = df.select(*[x.alias(c) for c, x in finite.items()])
    if centred:  # around the means from a pass before: differences of large sums would lose all digits
        means = known.agg(*[F.avg(c).alias(c) for c in columns]).first()
        known = known.select(*[(F.col(c) - F.lit(means[c] or 0.0)).alias(c) for c in columns])
    filled = known.fillna(0.0)
    vectors = VectorAssembler(inputCols=columns, outputCol="_row").transform(filled).select("_row")
    rows = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "_row"), numCols=len(columns))
    return rows.computeGramianMatrix().toArray()


def inflation_factors(gram: np.ndarray) -> np.ndarray:
    """VIF of each column: its squared length over what the other columns leave unexplained."""
    p = gram.shape[0]
    factors = np.empty(p)
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        own, cross = gram[i, i], gram[np.ix_(rest, [i])][:, 0]
        if own <= 0:
            factors[i] = np.nan
            continue
        scale = np.sqrt(np.where(np.diag(gram)[rest] > 0, np.diag(gram)[rest], 1.0))
        unit = gram[np.ix_(rest, rest)] / np.outer(scale, scale)
        explained = (cross / scale) @ np.linalg.pinv(unit, rcond=1e-12, hermitian=True) @ (cross / scale)
        left = own - explained
        factors[i] = np.inf if left <= own * 1e-10 else own / left
    return factors


def vif_table(spark: SparkSession, columns: Sequence[str], factors: np.ndarray) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(columns, factors)]
    table = spark.createDataFrame(rows, "feature string, vif double")
    return table.orderBy(F.col("vif").desc(), F.col("feature"))


def variance_inflation(df: DataFrame, columns: Sequence[str], centred: bool = False) -> DataFrame:
    """(feature, vif), highest first.

    Uncentred by default: no constant is added to the columns.  ``centred`` gives the
    textbook form with an intercept.
    """
    factors = inflation_factors(gram_matrix(df, columns, centred))
    return vif_table(df.sparkSession, columns, factors)


def prune_collinear(
    df: DataFrame, columns: Sequence[str], limit: float = VIF_LIMIT, centred: bool = False
) -> tuple[list[str], list[tuple[str, float]], dict[str, float]]:
    """Drop the worst column until every VIF is below ``limit``.

    Returns (kept, dropped with their VIF, VIF of the kept).  The data is read once: a
    dropped column is a row and a column less of the Gram matrix.
    """
    kept, dropped = list(columns), []
    gram = gram_matrix(df, columns, centred)
    while kept:
        factors = np.nan_to_num(inflation_factors(gram), nan=0.0, posinf=np.inf)
        # factors equal up to rounding are a tie, which goes to the first name
        worst = min(range(len(kept)), key=lambda i: (-float(f"{factors[i]:.9e}"), kept[i]))
        if factors[worst] < limit:
            return kept, dropped, dict(zip(kept, map(float, factors)))
        dropped.append((kept.pop(worst), float(factors[worst])))
        gram = np.delete(np.delete(gram, worst, 0), worst, 1)
    return [], dropped, {}
