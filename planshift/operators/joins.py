"""Joins, with an exact way to spread keys that hold a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key list never grows with the data: at most 100 values are tracked.
HOT_KEYS_TRACKED = 100


def hot_values(df: DataFrame, *columns: str, share: float = 0.01) -> dict[str, dict]:
    """Per column, the values that hold at least ``share`` of the rows (at most 100 each) with their shares.

    One pass over those columns with a small sketch per task and no shuffle by key.  The
    lists only steer how ``lookup_join`` spreads rows; results do not depend on them.
    """
    sketches = [F.expr(f"approx_top_k(`{c}`, {HOT_KEYS_TRACKED}, 10000)").alias(c) for c in columns]
    found = df.select(*columns).agg(F.count(F.lit(1)).alias("_n"), *sketches).first()

    def heavy(items) -> dict:
        known = [i for i in items or [] if i["item"] is not None and i["count"] >= share * found["_n"]]
        return {i["item"]: i["count"] / found["_n"] for i in known}

    return {c: heavy(found[c]) for c in columns}


def lookup_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_column: str | None = None,
    hot: Mapping | None = None,
) -> DataFrame:
    """Inner or left join where the keys of ``hot`` (key: its share of ``many``) are spread over several tasks.

    A hot key gets twice as many salts as shuffle partitions that its rows would fill, so the
    rows per task stay the same at any size.  Rows take their salt from their content and
    their input partition: copies of one row are spread too, and a task that runs again gives
    the same salts.  The few rows of ``one`` with that key are repeated once per salt, so
    every pair still meets exactly once.  Rows without a key cannot match and are spread as
    well.  All other keys join as usual.
    """
    on = list(on)
    if not hot:
        return many.join(one, on, how)
    partitions = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(hot_column)
    salts = F
    for value, share in hot.items():
        salts = salts.when(key == value, math.ceil(2 * share * partitions) + 1)
    of_row = F.when(key.isNull(), partitions).otherwise(salts.otherwise(1))
    content = F.pmod(F.xxhash64(*many.columns, F.spark_partition_id()), of_row).cast("int")
    salted = many.withColumn("_salt", content)
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts.otherwise(1) - 1)))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def drop_copies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rows, found among the rows of the same keys.

    ``distinct`` would shuffle by all columns.  Here rows are clustered and sorted by the keys
    (and then by the rest) alone, which costs no exchange where they already are, and which
    later joins on these keys use as it is.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*rest)
    before = F.lag(row).over(Window.partitionBy(*keys).orderBy(*rest))
    return df.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(row)).drop("_before")


def period_pair(
    snapshots: DataFrame, current: str, previous: str, key: str = "account_id", column: str = "ym"
) -> DataFrame:
    """Accounts present in both periods; columns carry ``_m0`` (current) and ``_m1`` (previous)."""

    def side(period: str, suffix: str) -> DataFrame:
        rows = snapshots.filter(F.col(column) == period).drop(column)
        return rows.select([F.col(c).alias(c if c == key else c + suffix) for c in rows.columns])

    return side(current, "_m0").join(side(previous, "_m1"), key)


def within_days(later: Column, earlier: Column, low: int, high: int) -> Column:
    return F.datediff(later, earlier).between(low, high)


def _cell(key: str, stretch: Column) -> Column:
    # two cells under one number are spread alike, no more
    return F.xxhash64(key, stretch)


def _stretch(day: Column, low: int, high: int) -> Column:
    return F.floor(F.unix_date(day) / (high - low + 1))


def hot_cells(visits: DataFrame, key: str, visit_day: str, low: int = 0, high: int = 2, share: float = 0.01) -> dict:
    """The (account, stretch) cells of the bucketed ``join_recent`` that hold at least ``share`` of the visits.

    One pass over two columns with a small sketch per task, as in ``hot_values``.
    """
    cells = visits.select(_cell(key, _stretch(F.col(visit_day), low, high)).alias("_cell"))
    return hot_values(cells, "_cell", share=share)["_cell"]


def join_recent(
    sales: DataFrame,
    visits: DataFrame,
    key: str,
    sale_day: str,
    visit_day: str,
    low: int = 0,
    high: int = 2,
    form: str = "exploded",
    latest_only: bool = False,
    hot: Mapping | None = None,
) -> DataFrame:
    """Visits made ``low`` to ``high`` days before each sale of the same account.

    ``exploded`` turns the interval into ``high - low + 1`` exact days and joins on
    (account, day), so one busy account is spread over its days.  ``bucketed`` is for wide
    intervals: time is cut into stretches as long as the interval, a sale looks into the two
    it can reach and filters the days there.  The cells of ``hot`` (from ``hot_cells`` with the
    same interval) are spread over several tasks: each visit goes to one of them, the sales of
    the cell to all.  All forms give the same rows.
    ``latest_only`` keeps the last visit of each sale instead of all of them; equal sales stay apart.
    """
    names = sales.columns
    if latest_only:
        sales = sales.withColumn("_sale", F.monotonically_increasing_id())
    first, last_day = F.date_sub(sale_day, high), F.date_sub(sale_day, low)
    if form == "exploded":
        wanted = sales.withColumn(visit_day, F.explode(F.sequence(first, last_day)))
        joined = wanted.join(visits, [key, visit_day])
    elif form == "bucketed":
        ends = [_stretch(first, low, high), _stretch(last_day, low, high)]
        reached = sales.withColumn("_stretch", F.explode(F.array_distinct(F.array(*ends))))
        placed = visits.withColumn("_stretch", _stretch(F.col(visit_day), low, high))
        cell = _cell(key, F.col("_stretch"))
        placed, reached = placed.withColumn("_cell", cell), reached.withColumn("_cell", cell)
        met = lookup_join(placed, reached, [key, "_stretch", "_cell"], "inner", "_cell", hot)
        joined = met.filter(within_days(F.col(sale_day), F.col(visit_day), low, high))
    else:
        raise ValueError(f"unknown form {form!r}")
    extra = [c for c in visits.columns if c not in sales.columns and c != visit_day]
    joined = joined.select(*sales.columns, visit_day, *extra)
    if not latest_only:
        return joined
    last = joined.groupBy(*sales.columns).agg(F.max(F.struct(visit_day, *extra)).alias("_last"))
    return last.select(*names, "_last.*")


def join_daily(base: DataFrame, daily: DataFrame, key: str, day: str, daily_day: str) -> DataFrame:
    """Add the daily wide row of the same account and day; both day columns are kept."""
    right = daily.withColumnRenamed(key, "_daily_key")
    matched = (base[key] == right["_daily_key"]) & (base[day] == right[daily_day])
    return base.join(right, matched).drop("_daily_key")


def enrich(base: DataFrame, *sources: tuple[DataFrame, Sequence[str], Mapping]) -> DataFrame:
    """Left-join each ``(frame, key columns, hot values of the first key)`` in turn.

    A source may hold exact copies of a row; they are collapsed before the join, so they
    do not multiply ``base``, on the partitioning by key that the join needs anyway.
    Where both have a column, the source's values are kept.
    """
    for frame, keys, hot in sources:
        replaced = [c for c in frame.columns if c in base.columns and c not in keys]
        base = lookup_join(base.drop(*replaced), drop_copies(frame, keys), keys, "left", keys[0], hot)
    return base
