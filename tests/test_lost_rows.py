"""Rows and digits that used to get lost: NULL groups, copies, large counts, large means, empty mappings."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from planshift.functions.expressions import coded
from planshift.operators.collinearity import gram_matrix, inflation_factors
from planshift.operators.gains import area_under_curve, gains_table
from planshift.operators.joins import hot_cells, hot_values, join_recent, lookup_join
from planshift.operators.ranking import global_rank, running_totals


def test_null_groups_are_ranked(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 1), ("a", 2)], "g string, v int")
    got = sorted(map(tuple, global_rank(rows, [F.col("v")], ["g"]).collect()), key=repr)
    assert got == [("a", 1, 1, 2), ("a", 2, 2, 2), (None, 1, 1, 2), (None, 2, 2, 2)]
    summed = running_totals(rows, [F.col("v")], "v", ["g"]).collect()
    assert len(summed) == 4 and {r["whole"] for r in summed} == {3}


def test_null_samples_have_gains_and_area(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "s", i / 40, i % 3 % 2) for i in range(40)], "k int, sample string, p double, y int")
    gains = gains_table(rows, "p", "y", ["k"], ["sample"])
    assert {r["sample"] for r in gains.collect()} == {None, "s"}
    assert {r["sample"] for r in area_under_curve(rows, "p", "y", ["sample"]).collect()} == {None, "s"}


def test_area_pairs_beyond_64_bits(spark):
    both = F.lit(4_000_000_000).cast("bigint")
    row = spark.range(1).select((F.sum(both).cast("double") * F.max(both).cast("double")).alias("pairs")).first()
    assert row["pairs"] == pytest.approx(1.6e19)


def test_centred_gram_of_large_means(spark):
    draw = np.random.default_rng(0)
    a, b = draw.normal(size=2000), draw.normal(size=2000)
    frame = spark.createDataFrame([(float(1e9 + x), float(1e9 + y)) for x, y in zip(a, b)], "a double, b double")
    assert inflation_factors(gram_matrix(frame, ["a", "b"], centred=True)) == pytest.approx([1.0, 1.0], abs=0.01)


def test_empty_mapping_gives_the_default(spark):
    assert spark.range(1).select(coded(F.col("id"), {}, 7).alias("c")).first()["c"] == 7


def test_equal_sales_stay_apart_with_latest_only(spark):
    day = dt.date(2020, 1, 3)
    sales = spark.createDataFrame([(1, day), (1, day)], "k int, day date")
    visits = spark.createDataFrame([(1, dt.date(2020, 1, 2)), (1, day)], "k int, visit_day date")
    got = join_recent(sales, visits, "k", "day", "visit_day", latest_only=True).collect()
    assert [r["visit_day"] for r in got] == [day, day]


def test_copies_of_one_row_are_spread_and_matched_once(spark):
    many = spark.range(4000, numPartitions=8).select(F.lit(1).alias("k"), F.lit("same").alias("x"))
    one = spark.createDataFrame([(1, "v")], "k int, v string")
    hot = hot_values(many, "k")["k"]
    assert hot == {1: 1.0}
    assert lookup_join(many, one, ["k"], "inner", "k", hot).count() == 4000
    salted = many.select(F.pmod(F.xxhash64("k", "x", F.spark_partition_id()), F.lit(17)).alias("s"))
    assert salted.distinct().count() > 1


def test_salts_grow_with_the_share(spark):
    many = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    one = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    for share in (0.05, 0.5):
        plan = lookup_join(many, one, ["k"], "left", "k", {0: share})._jdf.queryExecution().toString()
        assert f"THEN {math.ceil(2 * share * 8) + 1}" in plan
    assert lookup_join(many, one, ["k"], "left", "k", {0: 0.5}).count() == 100


def test_busy_cells_of_the_bucketed_join_are_spread(spark):
    """One account holds a third of the visits, on one day."""
    visits = spark.range(9000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("visit"),
        F.date_add(F.lit("2024-01-01"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 28).cast("int")).alias("seen"),
    )
    sales = spark.range(1500).select(
        F.when(F.col("id") < 10, 0).otherwise(F.col("id")).alias("k"),
        F.date_add(F.lit("2024-01-01"), F.when(F.col("id") < 10, F.col("id") + 4).otherwise(F.col("id") % 40).cast("int")).alias("sold"),
    )
    hot = hot_cells(visits, "k", "seen", 1, 14)
    assert len(hot) == 1 and 0.3 < next(iter(hot.values())) < 0.4
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for name, value in zip(names, ("false", "-1")):
            spark.conf.set(name, value)
        plain, spread = (join_recent(sales, visits, "k", "sold", "seen", 1, 14, "bucketed", hot=h) for h in (None, hot))
        rows = [sorted(map(tuple, df.collect())) for df in (plain, spread)]
        shares = [
            df.filter("k = 0").groupBy(F.spark_partition_id().alias("at")).count().agg((F.max("count") / F.sum("count")).alias("m")).first()["m"]
            for df in (plain, spread)
        ]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert rows[0] == rows[1] and len(rows[0]) > 20000
    assert shares[0] == 1 and shares[1] < 0.6


def test_rows_without_key_or_day_match_nothing_in_any_form(spark):
    visits = spark.createDataFrame([(1, None), (None, dt.date(2024, 1, 1)), (1, dt.date(2024, 1, 1))], "k int, seen date")
    sales = spark.createDataFrame([(1, dt.date(2024, 1, 2)), (None, dt.date(2024, 1, 2)), (1, None)], "k int, sold date")
    hot = hot_cells(visits, "k", "seen", 0, 2, share=0.0)
    for settings in ({"form": "exploded"}, {"form": "bucketed"}, {"form": "bucketed", "hot": hot}):
        got = join_recent(sales, visits, "k", "sold", "seen", 0, 2, **settings).collect()
        assert [r["seen"] for r in got] == [dt.date(2024, 1, 1)]
