"""Exact global order statistics without a window over all rows.

The rows are stored, range-partitioned and sorted inside their partitions; the running row
number that Spark gives each row there, plus the row counts of the partitions before it, is the
global rank.  Nothing but one count per partition is ever brought together.  Range bounds come
from a sample of the stored rows, so that whatever makes them runs once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planshift.operators.columns import cells, known_doubles
from planshift.sources.tables import pinned

# monotonically_increasing_id holds the partition above 33 bits of row number.
ROW_BITS = 33


def _sorted_pieces(
    df: DataFrame, group_by: Sequence[str], order_by: Sequence[Column], pieces: int | None, ready: bool = False
) -> DataFrame:
    """Range-partitioned, locally sorted rows with ``_piece`` and ``_place``.

    The sample for the bounds is one more pass, so rows that are not ``ready`` (a stored table) are
    stored first and made once.  Bounds differ from run to run, so the outcome is stored too; every
    later use (counts, offsets, ranks) then sees the same pieces, also after a lost executor.
    """
    order = [*[F.col(g) for g in group_by], *order_by]
    rows = df if ready else pinned(df)
    ranged = rows.repartitionByRange(pieces, *order) if pieces else rows.repartitionByRange(*order)
    ordered = ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = ordered.withColumn("_piece", F.shiftright("_id", ROW_BITS)).withColumn(
        "_place", F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    )
    return pinned(placed.drop("_id"))


def _before(rows: DataFrame, group_by: Sequence[str], weight: Column, total: str) -> DataFrame:
    """Per (group, piece): weight in earlier pieces and group total.  One row per piece and group."""
    sums = rows.groupBy(*group_by, "_piece").agg(
        F.sum(weight).alias("_sum"), F.min("_place").alias("_first")
    )
    in_order = Window.partitionBy(*group_by).orderBy("_piece")
    earlier = F.sum("_sum").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(
        *group_by,
        "_piece",
        "_first",
        F.coalesce(earlier, F.lit(0)).alias("_earlier"),
        F.sum("_sum").over(Window.partitionBy(*group_by)).alias(total),
    )


def _with_offsets(rows: DataFrame, offsets: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Joins one small row per (piece, group) on; a NULL group is a group like any other."""
    renamed = offsets.withColumnsRenamed({"_piece": "_its_piece"} | {g: f"_its_{g}" for g in group_by})
    matched = rows["_piece"] == renamed["_its_piece"]
    for g in group_by:
        matched = matched & rows[g].eqNullSafe(renamed[f"_its_{g}"])
    return rows.join(F.broadcast(renamed), matched)


def global_rank(
    df: DataFrame,
    order_by: Sequence[Column],
    group_by: Sequence[str] = (),
    rank_name: str = "rank",
    total_name: str = "total",
    pieces: int | None = None,
    ready: bool = False,
) -> DataFrame:
    """Add the 1-based position of each row in its group and the group's row count.

    ``order_by`` has to be a total order for a repeatable result.  Groups are few (classes,
    samples, variables); a group of any size is spread over as many pieces as it needs.
    ``ready`` says that ``df`` reads a stored table, which then is not stored again.
    """
    rows = _sorted_pieces(df, group_by, order_by, pieces, ready)
    offsets = _before(rows, group_by, F.lit(1), total_name)
    # one small row per (piece, group): bounded by the partition count plus the group count
    ranked = _with_offsets(rows, offsets, group_by)
    position = F.col("_place") - F.col("_first") + F.col("_earlier") + 1
    return ranked.select(*df.columns, position.alias(rank_name), total_name)


def decile_of(rank: Column, total: Column, bins: int = 10) -> Column:
    """Quantile bin of an ascending rank, counted from the top: bin 1 holds the highest ranks.

    Edges are those of linear-interpolated quantiles over ranks 1..n with closed right ends,
    in whole numbers: bin from below = max(1, ceil(bins * (r - 1) / (n - 1))).
    """
    span = F.greatest(total - 1, F.lit(1))
    from_below = F.ceil(F.lit(bins) * (rank - 1) / span).cast("bigint")
    return (F.lit(bins + 1) - F.greatest(from_below, F.lit(1))).cast("int")


def assign_deciles(
    df: DataFrame,
    score: str,
    tie_break: Sequence[str],
    group_by: Sequence[str] = (),
    bins: int = 10,
    pieces: int | None = None,
) -> DataFrame:
    """Add ``decile`` (1 = highest scores); equal scores are ordered by the keys."""
    order = [F.col(score), *[F.col(k) for k in tie_break]]
    ranked = global_rank(df, order, group_by, "_rank", "_total", pieces)
    return ranked.withColumn("decile", decile_of(F.col("_rank"), F.col("_total"), bins)).drop("_rank", "_total")


def running_totals(
    df: DataFrame, order_by: Sequence[Column], weight: str, group_by: Sequence[str] = (), ready: bool = False
) -> DataFrame:
    """Add ``before`` and ``upto`` (sum of ``weight`` ahead of and including the row) and ``whole``.

    Sums run inside the pieces and continue over the totals of earlier pieces, within each group.
    """
    rows = _sorted_pieces(df, group_by, order_by, None, ready)
    offsets = _before(rows, group_by, F.col(weight), "whole")
    inside = Window.partitionBy("_piece", *group_by).orderBy(*order_by)
    so_far = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # one small row per (piece, group), as in global_rank
    joined = _with_offsets(rows, offsets, group_by)
    summed = joined.withColumn("upto", F.col("_earlier") + so_far)
    return summed.select(*df.columns, (F.col("upto") - F.col(weight)).alias("before"), "upto", "whole")


# Rank accuracy of the sketches (one part in so many), and how far brackets may reach around a wanted rank, in such parts.
SKETCH_PARTS = 10_000
REACHES = (2, 20, 200, 2000)


def edge_sketch(value: Column, probabilities: Sequence[float]) -> Column:
    """Aggregate: approximate values around the wanted ranks, for every reach, by one sketch that tasks merge."""
    shares = [min(max(p + side * r / SKETCH_PARTS, 0.0), 1.0) for r in REACHES for p in sorted(probabilities) for side in (-1, 1)]
    return F.percentile_approx(value, shares, SKETCH_PARTS)


def bracket_edges(n: int, sketched: Sequence[float] | None, wanted: int, wider: int = 0) -> list[float]:
    """Lower and upper edges, in turns, of the ``wanted`` brackets of a column with ``n`` values.

    They reach as far as the sketch may be wrong, and two ranks at least, so that both neighbours of a rank
    are inside; ``wider`` takes a longer reach, at last all values.
    """
    fitting = [i for i, reach in enumerate(REACHES) if reach * n >= 2 * SKETCH_PARTS]
    level = (fitting[0] if fitting else len(REACHES)) + wider
    if sketched is None or level >= len(REACHES):
        return [float("-inf"), float("inf")]
    return list(sketched[2 * wanted * level:2 * wanted * (level + 1)])


def _apart(edges: Sequence[float] | None, brackets: int) -> list[tuple[float, float]]:
    """Ascending brackets that do not touch; empty ones at the end take the place of those that ran together."""
    found: list[list[float]] = []
    for low, high in zip((edges or [])[::2], (edges or [])[1::2]):
        if found and low <= found[-1][1]:
            found[-1][1] = max(high, found[-1][1])
        else:
            found.append([low, high])
    return [*map(tuple, found), *[(float("inf"), float("-inf"))] * (brackets - len(found))]


def _counted_between(df: DataFrame, edges: dict[str, Sequence[float] | None], brackets: int) -> DataFrame:
    """Counts (``_n``) per feature of the values inside its brackets, and of each gap between them as a whole.

    ``_gap`` numbers gaps and brackets in ascending order; even ones are gaps, which have no ``value``.  A map task
    sends one row per gap and one per different value inside a bracket, so little more than the brackets is shuffled.
    """
    columns = list(edges)
    apart = [_apart(edges[c], brackets) for c in columns]
    long = cells(df, known_doubles(columns)).filter(F.col("value").isNotNull())
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature")).cast("int")

    def edge(bracket: int, side: int) -> Column:
        return F.element_at(F.array(*[F.lit(a[bracket][side]) for a in apart]), F.col("_place"))

    gap = F.lit(0)
    for i in range(brackets):
        real = edge(i, 0) <= edge(i, 1)
        gap += F.when(real & (F.col("value") >= edge(i, 0)), 1).otherwise(0)
        gap += F.when(real & (F.col("value") > edge(i, 1)), 1).otherwise(0)
    placed = long.withColumn("_place", place).withColumn("_gap", gap)
    inside = F.when(F.col("_gap") % 2 == 1, F.col("value"))
    return placed.select("feature", "_gap", inside.alias("value")).groupBy("feature", "_gap", "value").agg(F.count(F.lit(1)).alias("_n"))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    edges: dict[str, Sequence[float]] | None = None,
    wider: int = 0,
) -> DataFrame:
    """Linear-interpolated quantiles of many columns: one row (feature, q1, q2, ...) each.

    Two passes.  The first takes a mergeable sketch of every column, whose rank error is bounded, and reads
    off it a bracket of values around each wanted rank (``edges``, if the caller has them from a pass
    of its own).  The second counts the values inside the brackets one by one and all others by the gap
    they fall in; running counts then point at the two order statistics around each wanted position.
    A value that fills a third of a column is one row from then on.  Where a bracket misses its rank
    all the same, the columns concerned are counted again with wider ones, at last with all values.
    NULL and NaN do not take part.
    """
    columns, names = list(columns), [f"q{round(p * 100):02d}" for p in probabilities]
    if edges is None:
        value = F.col("value")
        found = cells(df, known_doubles(columns)).groupBy("feature").agg(
            F.count(value).alias("n"), edge_sketch(value, probabilities).alias("edges")
        )  # a row per column
        edges = {r["feature"]: bracket_edges(r["n"], r["edges"], len(names), wider) for r in found.collect()}
    counted = pinned(_counted_between(df, {c: edges.get(c) for c in columns}, len(probabilities)))
    spans = running_totals(counted, [F.col("_gap"), F.col("value")], "_n", ["feature"], ready=True)

    def at(position: Column, what: Column) -> Column:
        hit = (F.col("before") <= position) & (position < F.col("upto"))
        return F.max(F.when(hit, what))

    picks = []
    for name, p in zip(names, probabilities):
        where = F.lit(p) * (F.col("whole") - 1)
        picks += [
            at(F.floor(where), F.col("value")).alias(f"{name}_low"),
            at(F.ceil(where), F.col("value")).alias(f"{name}_high"),
            F.max(where - F.floor(where)).alias(f"{name}_part"),
        ]
    picked = pinned(spans.groupBy("feature").agg(*picks))
    sides = [F.col(f"{n}_{side}") for n in names for side in ("low", "high")]
    missed = [r["feature"] for r in picked.filter(F.greatest(*[s.isNull().cast("int") for s in sides]) == 1).select("feature").collect()]
    done = picked.filter(~F.col("feature").isin(missed)).select(
        "feature",
        *[
            (F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")).alias(n)
            for n in names
        ],
    )
    return done.unionByName(exact_quantiles(df, missed, probabilities, None, wider + 1)) if missed else done


def heaviest(df: DataFrame, by: str, tie_break: str, rows: int = 1) -> DataFrame:
    """The ``rows`` rows with the largest ``by``; Spark keeps only that many per task."""
    return df.orderBy(F.col(by).desc(), F.col(tie_break)).limit(rows)


def sort_down(df: DataFrame, by: str, tie_break: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie_break))
