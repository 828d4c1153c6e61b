"""Ranks, deciles, gains and trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.catalog.profiles import r6, rounded
from planshift.catalog.registry import query
from planshift.catalog.sql_parts import SINCE_LAST, given, trailing
from planshift.operators import gains as G
from planshift.operators.activity import days_since_last, trailing_totals
from planshift.operators.ranking import assign_deciles, global_rank
from planshift.sources import standins as S

KEYS = ["account_id", "day"]


def deciles(source: str, partition: str = "") -> str:
    """Rank and decile (1 = highest scores) of ``source`` rows, optionally within groups."""
    over = f"PARTITION BY {partition} " if partition else ""
    return (
        f"SELECT *, 11 - greatest(1, CAST(ceil(10.0 * (r - 1) / (n - 1)) AS INTEGER)) AS decile FROM ("
        f"SELECT *, row_number() OVER ({over}ORDER BY p, account_id, day) AS r, count(*) OVER ({over}) AS n FROM {source})"
    )


def counted(group: str = "") -> str:
    head = f"{group}, " if group else ""
    return (
        f"SELECT {head}decile, count(*) AS n, count(*) FILTER (WHERE target = 1) AS targets, "
        f"count(*) FILTER (WHERE target = 0) AS non_targets, sum(p) AS score_sum FROM ranked GROUP BY {head}decile"
    )


def gains(group: str = "") -> str:
    part = f"PARTITION BY {group}" if group else ""
    running = f"({part} ORDER BY decile)"
    return (
        "SELECT *, targets / nullif(sum(targets) OVER (" + part + "), 0) AS target_share, "
        "non_targets / nullif(sum(non_targets) OVER (" + part + "), 0) AS non_target_share, "
        f"sum(targets) OVER {running} / nullif(sum(targets) OVER ({part}), 0) AS target_running, "
        f"sum(non_targets) OVER {running} / nullif(sum(non_targets) OVER ({part}), 0) AS non_target_running FROM counted"
    )


SHARE_COLUMNS = ("target_share", "non_target_share", "target_running", "non_target_running")
SHARES_SQL = ", ".join(f"{r6(c)} AS {c}" for c in SHARE_COLUMNS)
LIFT_SQL = (
    f"{r6('target_running / (decile / 10.0)')} AS lift, "
    f"{r6('100 * abs(target_running - non_target_running)')} AS ks_at"
)


@query(
    "G1",
    "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank, "
    "count(*) OVER () AS total FROM orders",
)
def global_row_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return global_rank(orders, [F.col("o_totalprice"), F.col("o_orderkey")])


@query(
    "G1",
    given("scored", more={"ranked": deciles("scored")}) + "SELECT account_id, day, decile FROM ranked",
)
def score_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_deciles(S.formula_scores(spark, sf_dir), "p", KEYS).select(*KEYS, "decile")


@query(
    "G2",
    given("scored", more={"ranked": deciles("scored"), "counted": counted()})
    + f"SELECT decile, n, targets, non_targets, {r6('score_sum')} AS score_sum FROM counted",
)
def decile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = assign_deciles(S.formula_scores(spark, sf_dir), "p", KEYS)
    return rounded(G.decile_counts(ranked, "p", "target"), "score_sum")


@query(
    "G3 G4 G5",
    given("scored", more={"ranked": deciles("scored"), "counted": counted(), "gains": gains()})
    + f"SELECT decile, n, targets, non_targets, {r6('score_sum')} AS score_sum, {SHARES_SQL}, {LIFT_SQL} FROM gains",
)
def gains_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = G.gains_table(S.formula_scores(spark, sf_dir), "p", "target", KEYS)
    return rounded(table, "score_sum", *SHARE_COLUMNS, "lift", "ks_at")


@query(
    "G6 J13",
    given("scored", more={"ranked": deciles("scored", "sample"), "counted": counted("sample"), "gains": gains("sample")})
    + f"SELECT sample, decile, n, targets, non_targets, {r6('score_sum')} AS score_sum, {SHARES_SQL}, {LIFT_SQL} FROM gains",
)
def gains_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = G.gains_table(S.formula_scores(spark, sf_dir), "p", "target", KEYS, ["sample"])
    return rounded(table, "score_sum", *SHARE_COLUMNS, "lift", "ks_at")


@query(
    "G5",
    given("scored", more={"ranked": deciles("scored", "sample"), "counted": counted("sample"), "gains": gains("sample")})
    + f"SELECT sample, {r6('max(100 * abs(target_running - non_target_running))')} AS ks FROM gains GROUP BY 1",
)
def ks_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = G.gains_table(S.formula_scores(spark, sf_dir), "p", "target", KEYS, ["sample"])
    return rounded(G.ks_distance(table, ["sample"]), "ks")


# Three-class scores out of whole numbers: state of the order against its price and number of lines.
CLASS_ROWS = {
    "sized": "SELECT o_orderkey AS account_id, o_orderdate AS day, o_orderstatus, o_totalprice / 500000.0 AS sp, "
             "1 - o_totalprice / 500000.0 AS sf, year(o_orderdate) / 2100.0 AS so FROM orders",
    "scored": "SELECT account_id, day, k AS class, CASE k WHEN 'P' THEN sp WHEN 'F' THEN sf ELSE so END AS p, "
              "CASE WHEN o_orderstatus = k THEN 1 ELSE 0 END AS target "
              "FROM sized CROSS JOIN (SELECT unnest(['P', 'F', 'O']) AS k)",
    "ranked": deciles("scored", "class"),
    "counted": counted("class"),
    "gains": gains("class"),
}


def _class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice") / F.lit(500000.0)
    scored = S.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("account_id"),
        F.to_date("o_orderdate").alias("day"),
        "o_orderstatus",
        price.alias("sp"),
        (1 - price).alias("sf"),
        (F.year("o_orderdate") / F.lit(2100.0)).alias("so"),
    )
    return G.class_scores(scored, KEYS, "o_orderstatus", {"P": "sp", "F": "sf", "O": "so"})


@query(
    "G6 I2",
    given(more=CLASS_ROWS)
    + f"SELECT class, decile, n, targets, non_targets, {r6('score_sum')} AS score_sum, {SHARES_SQL}, {LIFT_SQL} FROM gains",
)
def gains_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = G.gains_table(_class_scores(spark, sf_dir), "score", "is_class", KEYS, ["class"])
    return rounded(table, "score_sum", *SHARE_COLUMNS, "lift", "ks_at")


TRAILED = ["web_view", "mobile_view", "total_view", "total_purchase"]


@query(
    "G9",
    given("daily")
    + f"SELECT account_id, day, {', '.join(TRAILED)}, {trailing(TRAILED, S.WINDOWS)} FROM daily",
)
def trailing_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = S.daily(spark, sf_dir).select(*KEYS, *TRAILED)
    return trailing_totals(daily, "account_id", "day", TRAILED, S.WINDOWS)


@query("G10", given("daily") + f"SELECT account_id, day, {SINCE_LAST} FROM daily")
def days_since_last_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = S.daily(spark, sf_dir).select(*KEYS)
    marked = days_since_last(days, "account_id", "day", "since_last")
    return marked.withColumn("since_last", F.col("since_last").cast("bigint"))
