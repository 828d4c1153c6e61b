"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows over terms (the places of their components). Queries and candidates are cut into blocks by
hash; every block of queries meets every block of candidates once. Within such a pair the candidates' postings are
built per term, and each term of the queries scatters its weights times the postings into a dense score array. A
partition selection keeps the k best of the block, and a window over k rows per block merges them. No query is compared
with a part of the candidates only, and no task holds more than one block of each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planshift.llm.shared import stored

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
LEAST_BLOCKS = 48
LONG = np.iinfo(np.int64)


def whole_steps(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component x, as double; null for vectors that are null or hold null or non-finite ones."""
    steps = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), steps)


def dense(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def accumulated(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, term by term: whole numbers, exact up to 64 bits and held at those limits beyond."""
    largest = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(queries.shape[1], 1)
    exact = np.float64 if largest < 2.0**53 else np.int64 if largest < 2.0**62 else object
    whole = (lambda m: np.vectorize(int, otypes=[object])(m)) if exact is object else (lambda m: m.astype(exact))
    queries, candidates = (whole(m) if m.size else m.astype(exact) for m in (queries, candidates))
    scores = np.zeros((len(queries), len(candidates)), dtype=exact)
    for term in range(queries.shape[1]):
        rows = np.flatnonzero(queries[:, term] != 0)
        posted = np.flatnonzero(candidates[:, term] != 0)
        if not len(rows) or not len(posted):
            continue
        weights = candidates[posted, term]
        added = np.multiply.outer(queries[rows, term], weights)
        if added.shape == scores.shape:  # every query and candidate has the term
            scores += added
        else:
            scores[np.ix_(rows, posted)] += added
    if exact is object:
        scores = np.clip(scores, LONG.min, LONG.max)
    return scores.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, without the rows of the query's own id."""
    allowed = np.flatnonzero(ids != own)
    if len(allowed) > k:
        values = scores[allowed]
        least = np.partition(values, len(values) - k)[len(values) - k]
        allowed = allowed[values >= least]
    # the bitwise complement turns the order round without leaving 64 bits
    return allowed[np.lexsort((ids[allowed], ~scores[allowed]))][:k]


def block_search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        names, parts = ["row", "query_id", "vec_id", "score"], []
        if len(queries) and len(candidates):
            width = max(queries["v"].map(len).max(), candidates["v"].map(len).max())
            ids, of, row = candidates["id"].to_numpy(), queries["id"].to_numpy(), queries["row"].to_numpy()
            places = dense(candidates["v"], width)
            wanted = dense(queries["v"], width)
            for at in range(0, len(of), 256):
                scores = accumulated(wanted[at:at + 256], places)
                for i, line in enumerate(scores, start=at):
                    top = best(line, ids, of[i], k)
                    parts.append((np.full(len(top), row[i]), np.full(len(top), of[i]), ids[top], line[top]))
        columns = zip(*parts, strict=True) if parts else ([np.zeros(0, np.int64)] for _ in names)
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, columns, strict=True)})

    return search


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """For each row whose ``key`` is divisible by ``every``: the ``k`` other rows of highest inner product.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``; fewer rows if there are fewer candidates. Components
    are taken as floor(``scale`` * x). Vectors that are null or hold null or non-finite components take no part, nor do
    rows without a key. Shorter vectors count as zero beyond their end. Ties go to smaller keys. Rows that repeat a key
    are candidates each by itself, but not of a query of that key; repeated queries get their rows each. Other columns
    are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_steps(vector, scale).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter(F.col("id") % every == 0)
    n, n_asked = rows.count(), asked.count()
    c_blocks = max(-(-n // CANDIDATE_BLOCK), LEAST_BLOCKS)
    q_blocks = max(-(-n_asked // QUERY_BLOCK), 1)
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    left = asked.withColumn("q", block(q_blocks, 1)).withColumn("c", every_of(c_blocks))
    right = rows.withColumn("c", block(c_blocks, 2)).withColumn("q", every_of(q_blocks))
    found = (
        left.groupBy("q", "c")
        .cogroup(right.groupBy("q", "c"))
        .applyInPandas(block_search(k), "row long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
