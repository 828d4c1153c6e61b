"""Scalar semantics that the driver tables do not show."""

import datetime as dt

from pyspark.sql import functions as F

from planshift.functions import expressions as X
from planshift.functions.fixed_values import EXCLUDED_COLUMNS, PRIOR_TIER_CODES, PRODUCT_MIX_CODES, TIER_RANKS
from planshift.operators import cleaning as K
from planshift.operators import filters as R
from planshift.operators.columns import drop_features, feature_set, rename_clashes, split_numeric_text


def values(df, column):
    return [row[column] for row in df.orderBy("id").collect()]


def frame(spark, cells, kind):
    return spark.createDataFrame(list(enumerate(cells)), f"id int, v {kind}")


def test_drop_class_keeps_unknown(spark):
    df = frame(spark, ["a", "b", None], "string")
    assert values(R.drop_class(df, "v", "a"), "v") == ["b", None]


def test_codes_and_defaults(spark):
    tiers = frame(spark, ["DIGITAL STARTER VIDEO", "DIGITAL ECONOMY VIDEO", "BASIC VIDEO", None], "string")
    assert values(tiers.withColumn("c", X.coded(F.col("v"), PRIOR_TIER_CODES, 3)), "c") == [1, 2, 3, 3]
    assert values(tiers.withColumn("c", X.tier_rank(F.col("v"), TIER_RANKS)), "c") == [30, 20, 10, None]
    assert values(tiers.withColumn("c", X.equals_flag(F.col("v"), "BASIC VIDEO")), "c") == [0, 0, 1, 0]
    mixes = frame(spark, ["VIDEO ONLY", "VIDEO/HSD", "VIDEO/HSD/CDV", "VIDEO/HSD/XH", "VIDEO/HSD/CDV/XH", "x", None], "string")
    assert values(mixes.withColumn("c", X.coded(F.col("v"), PRODUCT_MIX_CODES, 0)), "c") == [1, 2, 3, 4, 5, 0, 0]


def test_moved_up_with_unknown_rank(spark):
    df = spark.createDataFrame([(0, 20, 10), (1, 10, 20), (2, None, 10), (3, 10, None), (4, 10, 10)], "id int, a int, b int")
    assert values(df.withColumn("up", X.moved_up(F.col("a"), F.col("b"))), "up") == [1, 0, 0, 0, 0]


def test_cap(spark):
    df = frame(spark, [74.0, 74.5, 75.0, 900.0, None], "double")
    assert values(df.withColumn("c", X.capped(F.col("v"), 74, 75)), "c") == [74.0, 75.0, 75.0, 75.0, None]


def test_date_parts(spark):
    df = spark.createDataFrame([(0, 2019, 9, 5), (1, 2019, 13, 1), (2, 2019, 2, 31), (3, 33, 1, 1)], "id int, y int, m int, d int")
    dates = values(df.withColumn("day", X.date_from_parts(F.col("y"), F.col("m"), F.col("d"))), "day")
    assert dates == [dt.date(2019, 9, 5), None, None, dt.date(33, 1, 1)]


def test_day_difference_takes_text_and_dates(spark):
    df = spark.createDataFrame([(0, "2019-09-05", dt.date(2019, 9, 3)), (1, "no day", dt.date(2019, 9, 3))], "id int, a string, b date")
    assert values(df.withColumn("n", X.days_between(F.col("a"), F.col("b"))), "n") == [2, None]


def test_tidy_text(spark):
    df = frame(spark, ["ab", " ", None, "  "], "string")
    assert values(df.withColumn("t", X.tidy_text(F.col("v"))), "t") == ["AB", "NA", "NA", "  "]


def test_clean_cells(spark):
    df = spark.createDataFrame(
        [(0, "None", 1.5, 3), (1, "Y", float("nan"), None), (2, "N", None, 4), (3, " ", 0.0, 5), (4, None, 2.0, 6), (5, "Yes", 2.0, 7)],
        "id int, t string, d double, n int",
    )
    clean = K.clean_cells(df)
    assert values(clean, "t") == ["0", "1", "0", "0", "0", "Yes"]
    assert values(clean, "d") == [1.5, 0.0, 0.0, 0.0, 2.0, 2.0]
    assert values(clean, "n") == [3, 0, 4, 5, 6, 7]


def test_auto_numeric_is_all_or_nothing(spark):
    rows = [("1", "1", "1d", "1_0", "", None, " 2 ", "-.5e3", 7), ("2.5", "x", "2", "2", "3", "4", "3", "1.", 8)]
    names = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names[:8]) + ", c8 int")
    kinds = dict(K.auto_numeric(df).dtypes)
    assert [kinds[n] for n in names] == [
        "double", "string", "string", "string", "string", "double", "double", "double", "double",
    ]
    assert [row["c6"] for row in K.auto_numeric(df).collect()] == [2.0, 3.0]


def test_fills(spark):
    df = spark.createDataFrame([(0, None, None), (1, 2.0, " ")], "id int, d double, t string")
    assert values(K.fill_by_type(df, blank_is_missing=True), "t") == ["NA", "NA"]
    assert values(K.fill_sentinel(df), "d") == [99999.0, 2.0]
    assert values(K.fill_sentinel(df), "t") == ["NA", " "]


def test_split_hash_is_stable_under_repartition(spark):
    df = spark.range(500).withColumn("share", X.hash_share([F.col("id")], 3))
    again = spark.range(500).repartition(5).withColumn("share", X.hash_share([F.col("id")], 3))
    assert df.exceptAll(again).count() == 0
    assert df.filter((F.col("share") < 0) | (F.col("share") >= 1)).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", None, " ")], "k int, t string, n double, u string")
    numbers, texts, numeric, text = split_numeric_text(df.withColumn("target", F.lit(1)), ["u"], "target", ["k"])
    assert (numeric, text) == (["n"], ["t"])
    assert numbers.columns == ["k", "n", "target"] and numbers.first()["n"] == 0.0
    assert texts.first()["t"] == "A"
    assert drop_features(df, ["t", "k"], keep=["k"]).columns == ["k", "n", "u"]
    assert drop_features(df.withColumnRenamed("t", "geo_city")).columns == ["k", "n", "u"]
    assert len(EXCLUDED_COLUMNS) == 156
    assert rename_clashes(df, df.select("k"), "_r").columns == ["k_r", "t", "n", "u"]
    assert [len(feature_set(n)) for n in ("reduced_12", "broad_24", "genetic_36", "genetic_42")] == [12, 24, 36, 42]


def test_eligible_drops_unknown_courtesy(spark):
    sides = "status string, video_units int, product_count int, residential int, disconnected int, courtesy int".split(", ")
    schema = "id int, " + ", ".join(f.replace(" ", f"_{m} ") for m in ("m0", "m1") for f in sides)
    good, before = ("ACT", 1, 2, 1, 0, 0), ("ACT", 1, 2, 0, 1, 1)
    rows = [good + before, ("ACT", 1, 2, 1, 0, None) + before, ("ACT", 1, 2, 1, 0, 1) + before,
            ("OFF", 1, 2, 1, 0, 0) + before, good + ("ACT", 1, 0, 1, 0, 0), good + ("ACT", 2, 2, 1, 0, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    assert values(R.eligible(df), "id") == [0]
