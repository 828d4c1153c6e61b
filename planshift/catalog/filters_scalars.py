"""Row filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.catalog.registry import query
from planshift.catalog.sql_parts import given
from planshift.functions import expressions as X
from planshift.operators import filters as R
from planshift.operators.encoding import category_shares
from planshift.operators.joins import period_pair
from planshift.operators.metrics import confusion_matrix
from planshift.operators.profile import mostly_missing, numeric_profile
from planshift.plans.labels import matching_sales, tier_changes
from planshift.sources import standins as S


@query("C1 E1", given("eligible") + "SELECT account_id, tier_m0, tier_m1, products FROM eligible")
def eligible_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = period_pair(S.snapshots(spark, sf_dir), "1998", "1997")
    kept = R.eligible(pairs, S.LABELS.statuses)
    return kept.select("account_id", "tier_m0", "tier_m1", F.col("product_count_m0").alias("products"))


@query(
    "C2",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders "
    "WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1999-01-01'",
)
def sales_in_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    kept = R.day_range(orders, "o_orderdate", S.LABELS.day_from, S.LABELS.day_to)
    return kept.select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("C3", "SELECT p_partkey, p_brand, p_name FROM part WHERE p_brand LIKE 'Brand#1%' AND p_name LIKE '%o%'")
def text_pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part")
    kept = part.filter(R.text_matches("p_brand", prefix="Brand#1") & R.text_matches("p_name", contains="o"))
    return kept.select("p_partkey", "p_brand", "p_name")


@query("C2 C3 C4", given("sales") + "SELECT * FROM sales")
def task_code_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching_sales(S.sales(spark, sf_dir), S.LABELS)


@query(
    "C5",
    given("snap") + "SELECT account_id, ym, tier, courtesy FROM snap WHERE courtesy IS DISTINCT FROM 1",
)
def drop_rare_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.snapshots(spark, sf_dir).select("account_id", "ym", "tier", "courtesy")
    return R.drop_class(rows, "courtesy", 1)


@query(
    "C6",
    given("snap", "wide")
    + "SELECT 'courtesy' AS feature, count(courtesy) AS n, "
    "round((count(*) - count(courtesy)) * 100.0 / count(*), 6) + 0.0 AS missing_pct FROM snap "
    "HAVING (count(*) - count(courtesy)) * 100.0 / count(*) > 10",
)
def sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.snapshots(spark, sf_dir)
    table = numeric_profile(rows, ["video_units", "product_count", "residential", "courtesy"], "approx")
    return mostly_missing(table, 10).select("feature", "n", F.round("missing_pct", 6).alias("missing_pct"))


@query(
    "C7 K5",
    given("scored") + "SELECT account_id, day, mix_code FROM scored WHERE pred = 0 AND target = 1 AND mix_code <> 2",
)
def missed_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed = R.missed_positives(S.formula_scores(spark, sf_dir), code="mix_code")
    return missed.select("account_id", "day", "mix_code")


@query("D1", given("snap") + "SELECT account_id, ym, tier_rank FROM snap")
def tier_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.snapshots(spark, sf_dir).select(
        "account_id", "ym", X.tier_rank(F.col("tier"), S.TIERS).alias("tier_rank")
    )


@query("D2 E1", given("changes") + "SELECT * FROM changes")
def upgrade_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_changes(S.snapshots(spark, sf_dir), S.LABELS)


@query("D3", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS year_month FROM orders")
def year_month_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "orders").select("o_orderkey", X.year_month(F.col("o_orderdate")).alias("year_month"))


@query("D4", given("ev") + "SELECT event_id, day AS rebuilt FROM ev")
def date_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parted = S.with_date_parts(S.events(spark, sf_dir))
    rebuilt = X.date_from_parts(F.col("year"), F.col("month"), F.col("date"))
    return parted.select("event_id", rebuilt.alias("rebuilt"))


@query(
    "D5",
    "SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def day_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = S.table(spark, sf_dir, "lineitem"), S.table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = X.days_between(F.col("l_shipdate"), F.col("o_orderdate")).cast("bigint")
    return joined.select("l_orderkey", "l_linenumber", days.alias("days"))


@query(
    "D6",
    "SELECT event_id, CAST(CAST(ts AS VARCHAR)[1:10] AS DATE) AS day, "
    "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, TRY_CAST(event_type AS DATE) AS no_day FROM events",
)
def text_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select(
        "event_id",
        X.as_date(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        X.as_date(F.col("event_type")).alias("no_day"),
    )


@query(
    "D7",
    given("snap") + "SELECT account_id, ym, CASE WHEN tier = '1-URGENT' THEN 1 ELSE 0 END AS target FROM snap",
)
def binary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.snapshots(spark, sf_dir).select(
        "account_id", "ym", X.equals_flag(F.col("tier"), "1-URGENT").alias("target")
    )


@query(
    "D8",
    given("changes")
    + "SELECT account_id, CASE WHEN tier_from = '5-LOW' THEN 1 WHEN tier_from = '3-MEDIUM' THEN 2 ELSE 3 END "
    "AS prior_code FROM changes",
)
def prior_tier_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = tier_changes(S.snapshots(spark, sf_dir), S.LABELS)
    return changes.select("account_id", X.coded(F.col("tier_from"), S.PREP.prior_codes, 3).alias("prior_code"))


@query(
    "D9",
    given("attrs")
    + "SELECT account_id, CASE mix WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 "
    "WHEN 'HOUSEHOLD' THEN 4 ELSE 0 END AS mix_code FROM attrs",
)
def product_mix_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.attributes(spark, sf_dir).select("account_id", X.coded(F.col("mix"), S.MIX, 0).alias("mix_code"))


@query("D10", "SELECT c_custkey, CASE WHEN c_acctbal / 100 > 74 THEN 75 ELSE c_acctbal / 100 END AS tenure FROM customer")
def capped_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("c_acctbal") / 100
    return S.table(spark, sf_dir, "customer").select("c_custkey", X.capped(value, 74, 75).alias("tenure"))


@query("D11", "SELECT p_partkey, upper(p_name) AS name, upper(CAST(p_size AS VARCHAR)) AS size FROM part")
def upper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "part").select(
        "p_partkey", X.tidy_text(F.col("p_name")).alias("name"), X.tidy_text(F.col("p_size")).alias("size")
    )


SHARES = """
    SELECT o_orderpriority AS value,
           count(*) FILTER (WHERE o_orderstatus = 'P') / sum(count(*) FILTER (WHERE o_orderstatus = 'P')) OVER () AS e,
           count(*) FILTER (WHERE o_orderstatus <> 'P') / sum(count(*) FILTER (WHERE o_orderstatus <> 'P')) OVER () AS ne
    FROM orders GROUP BY 1"""


@query(
    "D12",
    given(more={"shares": SHARES})
    + "SELECT value, round(ln((e + 0.001) / (ne + 0.001)), 6) + 0.0 AS log_ratio FROM shares",
)
def smoothed_log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = category_shares(S.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["P"])
    ratio = X.smoothed_log_ratio(F.col("event_share"), F.col("non_event_share"))
    return shares.select("value", F.round(ratio, 6).alias("log_ratio"))


@query(
    "D13",
    given("scored")
    + "SELECT account_id, day, round(abs(p - target), 6) + 0.0 AS gap, round(100.0 * p, 6) + 0.0 AS p_pct FROM scored",
)
def absolute_gap_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.formula_scores(spark, sf_dir).select(
        "account_id",
        "day",
        F.round(F.abs(F.col("p") - F.col("target")), 6).alias("gap"),
        F.round(X.percent(F.col("p"), F.lit(1.0)), 6).alias("p_pct"),
    )


@query(
    "F12",
    given("scored", more={"k": "SELECT unnest([0, 1]) AS v"})
    + "SELECT a.v AS actual, b.v AS predicted, count(s.pred) AS n FROM k a CROSS JOIN k b "
    "LEFT JOIN scored s ON s.target = a.v AND s.pred = b.v GROUP BY 1, 2",
)
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_matrix(S.formula_scores(spark, sf_dir), "target", "pred", (0, 1))
