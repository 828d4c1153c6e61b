"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.catalog.registry import query
from planshift.catalog.sql_parts import COUNTERS, given
from planshift.operators import joins as J
from planshift.operators.columns import suffix_columns
from planshift.operators.encoding import apply_woe, weight_of_evidence
from planshift.plans.labels import matching_sales, tier_changes, upgrade_sales
from planshift.sources import standins as S

RECENT = given("buys", "visits") + (
    "SELECT b.account_id, b.day, v.visit_day, visits, pages FROM buys b JOIN visits v "
    "ON b.account_id = v.account_id AND date_diff('day', v.visit_day, b.day) BETWEEN 0 AND 2"
)


@query(
    "E1",
    given("snap")
    + "SELECT m0.account_id, m0.tier AS tier_m0, m1.tier AS tier_m1, m0.product_count AS product_count_m0, "
    "m1.product_count AS product_count_m1 FROM snap m0 JOIN snap m1 ON m0.account_id = m1.account_id "
    "WHERE m0.ym = '1998' AND m1.ym = '1997'",
)
def period_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = J.period_pair(S.snapshots(spark, sf_dir), "1998", "1997")
    return pairs.select("account_id", "tier_m0", "tier_m1", "product_count_m0", "product_count_m1")


@query(
    "E2",
    given("sales", "changes")
    + "SELECT s.account_id, account_number, day, product_mix, tier_to, tier_from FROM sales s "
    "JOIN changes c ON s.account_id = c.account_id WHERE upgraded = 1",
)
def sales_of_upgraded_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = matching_sales(S.sales(spark, sf_dir), S.LABELS)
    return upgrade_sales(sold, tier_changes(S.snapshots(spark, sf_dir), S.LABELS))


def _recent(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return J.join_recent(
        S.purchase_days(spark, sf_dir), S.visits(spark, sf_dir), "account_id", "day", "visit_day", **options
    )


@query("E3", RECENT)
def recent_visits_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recent(spark, sf_dir, form="exploded")


@query("E3", RECENT)
def recent_visits_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recent(spark, sf_dir, form="bucketed")


@query("E3", RECENT.replace("BETWEEN 0 AND 2", "BETWEEN 1 AND 14"))
def fortnight_visits_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recent(spark, sf_dir, low=1, high=14, form="bucketed")


BUSY = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END"


@query(
    "E3",
    f"WITH seen AS (SELECT event_id, {BUSY} AS account_id, CAST(ts AS DATE) AS visit_day FROM events "
    "WHERE event_type IN ('view', 'click')), "
    f"bought AS (SELECT DISTINCT {BUSY} AS account_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase') "
    "SELECT b.account_id, b.day, v.visit_day, event_id FROM bought b JOIN seen v "
    "ON b.account_id = v.account_id AND date_diff('day', v.visit_day, b.day) BETWEEN 1 AND 14",
)
def busy_account_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single visits of the last fortnight, where a third of all events belong to one account."""
    busy = F.expr(BUSY)
    events = S.table(spark, sf_dir, "events").select(
        "event_id", busy.alias("account_id"), F.to_date("ts").alias("visit_day"), F.col("event_type").alias("kind")
    )
    seen = events.filter(F.col("kind").isin(*S.VISIT_KINDS)).drop("kind")
    bought = events.filter("kind = 'purchase'").select("account_id", F.col("visit_day").alias("day")).distinct()
    hot = J.hot_cells(seen, "account_id", "visit_day", 1, 14)
    return J.join_recent(bought, seen, "account_id", "day", "visit_day", 1, 14, "bucketed", hot=hot)


@query(
    "E3",
    RECENT + " QUALIFY row_number() OVER (PARTITION BY b.account_id, b.day ORDER BY v.visit_day DESC) = 1",
)
def latest_recent_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recent(spark, sf_dir, latest_only=True)


@query(
    "E4 B4",
    given("visits", "daily")
    + "SELECT v.account_id, v.visit_day, visits, pages, d.day AS daily_day, "
    + ", ".join(COUNTERS)
    + " FROM visits v JOIN daily d ON v.account_id = d.account_id AND v.visit_day = d.day",
)
def daily_row_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = S.daily(spark, sf_dir).withColumnRenamed("day", "daily_day")
    return J.join_daily(S.visits(spark, sf_dir), daily, "account_id", "visit_day", "daily_day")


FLAGS = ", ".join(f"w.{k}_flag" for k in S.KINDS) + ", " + ", ".join(f"m.{k}_flag AS {k}_flag_m" for k in S.KINDS)


@query(
    "E5 B5",
    given("visits", "flags_web", "flags_mobile", "attrs")
    + f"SELECT v.*, {FLAGS}, tenure, mix FROM visits v "
    "LEFT JOIN flags_web w ON v.account_id = w.account_id AND v.visit_day = w.visit_day "
    "LEFT JOIN flags_mobile m ON v.account_id = m.account_id AND v.visit_day = m.visit_day "
    "LEFT JOIN attrs a ON v.account_id = a.account_id",
)
def triple_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = S.visits(spark, sf_dir)
    keys = ["account_id", "visit_day"]
    hot = J.hot_values(S.table(spark, sf_dir, "events"), "user_id")["user_id"]
    return J.enrich(
        visits,
        (S.flags(spark, sf_dir, "web"), keys, []),
        (suffix_columns(S.flags(spark, sf_dir, "mobile"), "_m", keep=keys), keys, []),
        (S.attributes(spark, sf_dir), ["account_id"], hot),
    )


@query(
    "E5",
    "SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderpriority FROM lineitem "
    "LEFT JOIN orders ON l_orderkey = o_orderkey",
)
def spread_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    heads = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    # the fixtures have no hot order, so the most frequent ones are spread whatever their share
    hot = J.hot_values(lines, "l_orderkey", share=0.0)["l_orderkey"]
    return J.lookup_join(lines, heads, ["l_orderkey"], "left", "l_orderkey", hot)


WOE_PARTS = {
    "counts": """
        SELECT mix_code, sample, count(*) FILTER (WHERE target = 1) AS e, count(*) FILTER (WHERE target = 0) AS ne
        FROM matrix GROUP BY 1, 2""",
    "by_mix": """
        SELECT mix_code, ln((sum(e) / sum(sum(e)) OVER () + 0.001) / (sum(ne) / sum(sum(ne)) OVER () + 0.001)) AS w
        FROM counts GROUP BY 1""",
    "by_sample": """
        SELECT sample, ln((sum(e) / sum(sum(e)) OVER () + 0.001) / (sum(ne) / sum(sum(ne)) OVER () + 0.001)) AS w
        FROM counts GROUP BY 1""",
}


@query(
    "E6",
    given("matrix", more=WOE_PARTS)
    + 'SELECT account_id, day, round(a.w, 6) + 0.0 AS "mix_code_WOE", round(b.w, 6) + 0.0 AS "sample_WOE" '
    "FROM matrix m JOIN by_mix a ON m.mix_code = a.mix_code JOIN by_sample b ON m.sample = b.sample",
)
def woe_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = S.activity_matrix(spark, sf_dir)
    variables = ["mix_code", "sample"]
    woe = weight_of_evidence(matrix, variables, "target", [1])
    coded = apply_woe(matrix.select("account_id", "day", *variables), woe, variables)
    return coded.select("account_id", "day", *[F.round(f"{v}_WOE", 6).alias(f"{v}_WOE") for v in variables])


@query(
    "E7",
    given("matrix", "scored")
    + "SELECT m.account_id, m.day, m.target, total_view_l7d, pred, round(p, 6) + 0.0 AS p FROM matrix m "
    "JOIN scored s ON m.account_id = s.account_id AND m.day = s.day",
)
def columns_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = S.activity_matrix(spark, sf_dir).select("account_id", "day", "target", "total_view_l7d")
    scores = S.formula_scores(spark, sf_dir).select("account_id", "day", "pred", F.round("p", 6).alias("p"))
    return features.join(scores, ["account_id", "day"])
