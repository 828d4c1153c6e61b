"""The engine's inputs, derived from the order / event star schema of the test tables.

``orders`` play the account snapshots (one period per year), ``lineitem`` with ``orders`` and
``part`` the sales records, ``events`` the visits, daily counters and page flags, and
``customer`` the account attributes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.functions.expressions import coded
from planshift.operators.activity import daily_counters, days_since_last, page_flags, trailing_totals
from planshift.plans.labels import LabelSpec
from planshift.plans.prepare import PrepSpec
from planshift.sources.tables import read_table

KINDS = ("view", "click", "purchase", "signup", "error")
VISIT_KINDS = ("view", "click")
WINDOWS = (3, 7, 14, 15)
TIERS = {"5-LOW": 10, "3-MEDIUM": 20, "2-HIGH": 30, "1-URGENT": 40}
MIX = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4}
LABELS = LabelSpec(
    current="1998",
    previous="1997",
    day_from=dt.date(1998, 1, 1),
    day_to=dt.date(1999, 1, 1),
    tier_ranks=TIERS,
    statuses=("O", "P"),
    channel_contains=None,
    channel_prefix="Brand#1",
    task_contains="o",
    task_prefix=None,
    sub_task="R",
)
PREP = PrepSpec(
    class_column="tier_to",
    positive="1-URGENT",
    rare="3-MEDIUM",
    prior_column="tier_from",
    prior_codes={"5-LOW": 1, "3-MEDIUM": 2},
    prior_name="prior_code",
    mix_column="mix",
    mix_codes=MIX,
    mix_name="mix_code",
    cap_column="tenure",
    keys=("account_id", "day"),
)
OOT1_BEFORE = dt.date(2024, 1, 9)
DEV_UNTIL = dt.date(2024, 1, 22)

# Features of the user-day matrix; purchases are the target and stay out.
FEATURES = [
    "web_view", "web_click", "mobile_view", "mobile_click", "total_view_l3d", "total_view_l7d",
    "total_click_l3d", "total_click_l7d", "total_error_l7d", "total_signup_l7d", "since_last",
    "tenure", "mix_code",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per account and year: state of the last order, counts over all of them."""
    orders = table(spark, sf_dir, "orders")
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus"))
    per_year = orders.groupBy("o_custkey", F.year("o_orderdate").cast("string").alias("ym")).agg(
        last.alias("last"),
        F.count(F.lit(1)).alias("product_count"),
        F.max("o_totalprice").alias("top"),
        F.min("o_totalprice").alias("low"),
        F.count_if(F.col("o_orderstatus") != "F").alias("open_orders"),
    )
    tier = F.col("last.o_orderpriority")
    return per_year.select(
        F.col("o_custkey").alias("account_id"),
        "ym",
        tier.alias("tier"),
        F.col("last.o_orderstatus").alias("status"),
        F.when(F.col("top") >= 10000, 1).otherwise(0).alias("video_units"),
        "product_count",
        F.when(F.col("top") < 495000, 1).otherwise(0).alias("residential"),
        F.when(F.col("open_orders") == 0, 1).otherwise(0).alias("disconnected"),
        F.when(tier != "4-NOT SPECIFIED", F.when(F.col("low") < 1500, 1).otherwise(0)).alias("courtesy"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sale lines with account, day, channel, task, sub-task and mix."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("sub_task")
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_brand").alias("channel"),
        F.col("p_name").alias("task"),
        F.col("p_type").alias("product_mix"),
    )
    heads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("account_id")
    )
    with_part = lines.distinct().join(parts, "l_partkey").drop("l_partkey")
    with_head = with_part.join(heads, "l_orderkey")
    return with_head.withColumnRenamed("l_orderkey", "account_number")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("account_id"),
        F.to_date("ts").alias("day"),
        F.col("event_type").alias("kind"),
        F.when(number % 2 == 0, "web").otherwise("mobile").alias("channel"),
        "value",
    )


def purchase_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct account-days with a purchase: the sale days of the activity tables."""
    return events(spark, sf_dir).filter(F.col("kind") == "purchase").select("account_id", "day").distinct()


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per account and day with views or clicks."""
    seen = events(spark, sf_dir).filter(F.col("kind").isin(*VISIT_KINDS))
    return seen.groupBy("account_id", F.col("day").alias("visit_day")).agg(
        F.count(F.lit(1)).alias("visits"), F.count_if(F.col("kind") == "view").alias("pages")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per account and day."""
    return daily_counters(events(spark, sf_dir), "account_id", "day", "channel", "kind", KINDS)


def daily_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters with trailing totals of every channel and ``since_last``."""
    counters = daily(spark, sf_dir)
    metrics = [c for c in counters.columns if c not in ("account_id", "day")]
    wide = trailing_totals(counters, "account_id", "day", metrics, WINDOWS)
    return _since_last(wide)


def _since_last(daily_rows: DataFrame) -> DataFrame:
    marked = days_since_last(daily_rows, "account_id", "day", "since_last")
    return marked.withColumn("since_last", F.col("since_last").cast("bigint"))


def with_date_parts(df: DataFrame) -> DataFrame:
    """The day as numeric year / month / date parts, as a date-partitioned table has it."""
    day = F.col("day")
    return df.select(
        *[c for c in df.columns if c != "day"],
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("date"),
    )


def flags(spark: SparkSession, sf_dir: str, channel: str) -> DataFrame:
    rows = events(spark, sf_dir).filter(F.col("channel") == channel)
    return page_flags(rows.withColumnRenamed("day", "visit_day"), ["account_id", "visit_day"], "kind", KINDS)


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.floor(F.col("c_acctbal") / 100).alias("tenure"),
        F.col("c_mktsegment").alias("mix"),
    )


def activity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-day matrix: ``FEATURES``, 0/1 ``target`` (purchase that day) and ``sample``."""
    counters = daily(spark, sf_dir)
    totals = ["total_view", "total_click", "total_error", "total_signup"]
    wide = _since_last(trailing_totals(counters, "account_id", "day", totals, (3, 7)))
    # one row per account and day by now: no account is large
    joined = wide.join(attributes(spark, sf_dir), "account_id", "left")
    sample = (
        F.when(F.col("day") < F.lit(OOT1_BEFORE), "oot1").when(F.col("day") <= F.lit(DEV_UNTIL), "dev").otherwise("oot2")
    )
    return joined.select(
        "account_id",
        "day",
        sample.alias("sample"),
        *[c for c in FEATURES if c not in ("since_last", "tenure", "mix_code")],
        F.coalesce("since_last", F.lit(0)).alias("since_last"),
        F.coalesce(F.when(F.col("tenure") > 74, 75).otherwise(F.col("tenure")), F.lit(0)).cast("bigint").alias("tenure"),
        coded(F.col("mix"), MIX, 0).alias("mix_code"),
        F.when(F.col("total_purchase") > 0, 1).otherwise(0).alias("target"),
    )


def formula_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-days with a score that is a fixed formula of integer counts (no model)."""
    points = (
        3 * F.col("total_click_l7d") + 2 * F.col("total_view_l3d") + F.col("mix_code") + F.col("web_view") * 5
    )
    rows = activity_matrix(spark, sf_dir).withColumn("points", points)
    p = F.col("points") / (F.col("points") + F.lit(20.0))
    return rows.select(
        "account_id",
        "day",
        "sample",
        "target",
        "mix_code",
        F.when(F.col("points") >= 20, 1).otherwise(0).alias("pred"),
        p.alias("p"),
    )
