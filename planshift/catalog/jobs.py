"""The composite jobs a user calls."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planshift.catalog.modelling import KEYS, matrix, samples
from planshift.catalog.profiles import EVIDENCE, PROFILE_ROUNDED, profile_sql, r6, rounded
from planshift.catalog.registry import query
from planshift.catalog.sql_parts import COUNTERS, given
from planshift.operators.columns import model_matrix
from planshift.plans.dataset import DatasetSpec, build_dataset
from planshift.plans.development import develop
from planshift.plans.explanation import explain
from planshift.plans.labels import Period, build_labels, build_labels_over
from planshift.plans.prepare import fit_prep, prepare, training_matrix
from planshift.plans.report import profile_report
from planshift.plans.selection import select_features
from planshift.plans.training import score_and_evaluate, train
from planshift.session import work_path
from planshift.sources import standins as S
from planshift.sources.tables import materialize


@query("N1 A2 C1 C2 C3 C4 D1 D2 D3 E1 E2 F1", given("labels_") + "SELECT * FROM labels_")
def label_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_labels(S.sales(spark, sf_dir), S.snapshots(spark, sf_dir), S.LABELS)


PERIODS = [Period(str(y), str(y - 1), dt.date(y, 1, 1), dt.date(y + 1, 4, 1)) for y in (1996, 1997, 1998)]
ANY_STATUS = replace(S.LABELS, statuses=("O", "P", "F"))
OVER_PERIODS = {
    "periods": " UNION ALL ".join(
        f"SELECT '{p.current}' AS period, '{p.previous}' AS before, DATE '{p.day_from}' AS day_from, DATE '{p.day_to}' AS day_to"
        for p in PERIODS
    ),
    "paired": """
        SELECT period, day_from, day_to, m0.account_id, m0.tier AS tier_to, m1.tier AS tier_from
        FROM periods JOIN snap m0 ON m0.ym = period JOIN snap m1 ON m1.ym = before AND m1.account_id = m0.account_id
        WHERE m0.status IN ('O', 'P', 'F') AND m1.status IN ('O', 'P', 'F') AND m0.video_units = 1 AND m1.video_units = 1
          AND m0.product_count > 0 AND m1.product_count > 0 AND m0.residential = 1 AND m0.disconnected = 0
          AND m0.courtesy <> 1 AND m0.tier_rank > m1.tier_rank""",
}


@query(
    "N1 E1 E2 C2",
    given("snap", "sold", more=OVER_PERIODS)
    + "SELECT DISTINCT period, s.account_id, account_number, day, strftime(day, '%Y%m') AS year_month, tier_to, tier_from, "
    "product_mix FROM sold s JOIN paired b ON s.account_id = b.account_id AND day >= day_from AND day < day_to "
    "WHERE channel LIKE 'Brand#1%' AND task LIKE '%o%' AND sub_task = 'R'",
)
def label_job_over_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three periods whose sale windows overlap; any status, so that all three have upgrades."""
    return build_labels_over(S.sales(spark, sf_dir), S.snapshots(spark, sf_dir), ANY_STATUS, PERIODS)


FLAGS = ", ".join(f"w.{k}_flag" for k in S.KINDS) + ", " + ", ".join(f"m.{k}_flag AS {k}_flag_m" for k in S.KINDS)


def _dataset(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    return build_dataset(
        S.purchase_days(spark, sf_dir),
        S.visits(spark, sf_dir),
        S.with_date_parts(S.daily(spark, sf_dir)) if daily is None else daily,
        S.flags(spark, sf_dir, "web"),
        S.flags(spark, sf_dir, "mobile"),
        S.attributes(spark, sf_dir),
        DatasetSpec(year=2024, first_month=1, after_day=3),
    )


DATASET_SQL = (
    given("buys", "visits", "daily", "flags_web", "flags_mobile", "attrs")
    + "SELECT b.account_id, b.day, v.visit_day, visits, pages, d.day AS daily_day, "
    + ", ".join(COUNTERS)
    + f", {FLAGS}, tenure, mix FROM buys b "
    "JOIN visits v ON b.account_id = v.account_id AND date_diff('day', v.visit_day, b.day) BETWEEN 0 AND 2 "
    "JOIN daily d ON v.account_id = d.account_id AND v.visit_day = d.day "
    "LEFT JOIN flags_web w ON v.account_id = w.account_id AND v.visit_day = w.visit_day "
    "LEFT JOIN flags_mobile m ON v.account_id = m.account_id AND v.visit_day = m.visit_day "
    "LEFT JOIN attrs a ON v.account_id = a.account_id "
    "WHERE year(d.day) = 2024 AND month(d.day) >= 1 AND day(d.day) > 3"
)


@query("N2 A3 B3 B4 B5 D4 D5 E3 E4 E5 F1", DATASET_SQL)
def dataset_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir)


@query("N2 A3 A4 E4", DATASET_SQL)
def dataset_job_on_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table lies in folders by year, month and date; only those of the wanted days are read."""
    daily = materialize(S.with_date_parts(S.daily(spark, sf_dir)), work_path(spark, "daily"), ("year", "month", "date"))
    return _dataset(spark, sf_dir, daily)


# The rows to prepare: every account-year with the tier before, raw attributes and sentinels.
UNPREPARED = {
    "tiers": "SELECT account_id, ym, tier AS tier_to, lag(tier) OVER (PARTITION BY account_id ORDER BY ym) AS tier_from, "
             "status, product_count FROM snap",
    "unprepared": """
        SELECT t.account_id, t.ym AS day, tier_to, tier_from, product_count,
               CASE status WHEN 'P' THEN 'Y' WHEN 'F' THEN 'N' ELSE ' ' END AS open_flag,
               CASE WHEN product_count > 1 THEN CAST(product_count AS VARCHAR) ELSE 'None' END AS orders_text,
               CASE WHEN mix <> 'MACHINERY' THEN tenure END AS tenure, nullif(mix, 'MACHINERY') AS mix
        FROM tiers t LEFT JOIN attrs a ON t.account_id = a.account_id""",
    "prepared": """
        SELECT account_id, day,
               CASE WHEN tier_to = '1-URGENT' THEN 1 ELSE 0 END AS target,
               CASE WHEN tier_from = '5-LOW' THEN 1.0 WHEN tier_from = '3-MEDIUM' THEN 2.0 ELSE 3.0 END AS prior_code,
               CASE mix WHEN 'AUTOMOBILE' THEN 1.0 WHEN 'BUILDING' THEN 2.0 WHEN 'FURNITURE' THEN 3.0
                        WHEN 'HOUSEHOLD' THEN 4.0 ELSE 0.0 END AS mix_code,
               CAST(product_count AS DOUBLE) AS product_count,
               CASE open_flag WHEN 'Y' THEN 1.0 ELSE 0.0 END AS open_flag,
               CASE orders_text WHEN 'None' THEN 0.0 ELSE CAST(orders_text AS DOUBLE) END AS orders_text,
               CAST(CASE WHEN coalesce(tenure, 0) > 74 THEN 75 ELSE coalesce(tenure, 0) END AS DOUBLE) AS tenure,
               tier_to, coalesce(tier_from, '0') AS tier_from, coalesce(mix, '0') AS mix
        FROM unprepared WHERE tier_to IS DISTINCT FROM '3-MEDIUM'""",
}
PREPARED_FEATURES = ["prior_code", "mix_code", "product_count", "open_flag", "orders_text", "tenure"]
PREPARED_CASTS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PREPARED_FEATURES)


def _unprepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one row per account and year, so a window never exceeds the years on record
    before = F.lag("tier").over(Window.partitionBy("account_id").orderBy("ym"))
    years = S.snapshots(spark, sf_dir).withColumn("tier_from", before)
    count = F.col("product_count")
    return years.join(S.attributes(spark, sf_dir), "account_id", "left").select(
        "account_id",
        F.col("ym").alias("day"),
        F.col("tier").alias("tier_to"),
        "tier_from",
        "product_count",
        F.when(F.col("status") == "P", "Y").when(F.col("status") == "F", "N").otherwise(" ").alias("open_flag"),
        F.when(count > 1, count.cast("string")).otherwise("None").alias("orders_text"),
        F.when(F.col("mix") != "MACHINERY", F.col("tenure")).alias("tenure"),  # unknown for some accounts
        F.nullif("mix", F.lit("MACHINERY")).alias("mix"),
    )


@query(
    "N3 C5 D7 D8 D9 D10 H1 H5 H6 H7",
    given("snap", "attrs", more=UNPREPARED)
    + f"SELECT account_id, day, target, {PREPARED_CASTS}, tier_to, tier_from, mix FROM prepared",
)
def prepare_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned on the years up to 1998, applied to all years."""
    rows = _unprepared(spark, sf_dir)
    return prepare(rows, fit_prep(rows.filter(F.col("day") <= "1998"), S.PREP))


@query(
    "N3 B8 F2",
    given("snap", "attrs", more=UNPREPARED)
    + f"SELECT min((account_id, day))[1] AS account_id, min((account_id, day))[2] AS day, {PREPARED_CASTS}, target "
    f"FROM prepared GROUP BY {', '.join(PREPARED_FEATURES)}, target",
)
def training_matrix_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_matrix(prepare(_unprepared(spark, sf_dir), S.PREP), PREPARED_FEATURES, S.PREP)


@query(
    "N3",
    given("snap", "attrs", more=UNPREPARED)
    + "SELECT account_id, day, CASE tier_to WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 3 END AS target "
    "FROM unprepared",
)
def multiclass_label_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = replace(S.PREP, class_codes={"1-URGENT": 1, "2-HIGH": 2, "5-LOW": 3})
    return prepare(_unprepared(spark, sf_dir), spec).select("account_id", "day", "target")


@query(
    "N4 F11",
    given(more=EVIDENCE) + f"SELECT variable, {r6('sum((event_pct - non_event_pct) * woe)')} AS iv FROM evidence GROUP BY 1",
)
def profile_report_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("string").alias("order_year")
    )
    report = profile_report(orders, "o_orderstatus", ["P", "F", "O"])
    return rounded(report["information_value"], "iv")


@query("N4 F7", given("matrix") + profile_sql(S.FEATURES, "matrix"))
def profile_report_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.activity_matrix(spark, sf_dir)
    table = profile_report(rows, "target", [1], KEYS, quantiles="exact")["numeric"]
    return rounded(table, *PROFILE_ROUNDED)


ORDER_REPORT = {
    "taken": "SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, "
    "o_totalprice, o_custkey FROM orders",
    "shares": "SELECT o_orderstatus AS item, count(*) AS n FROM taken WHERE o_orderstatus IS NOT NULL GROUP BY 1",
}
REPORT_COLUMNS = ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")


@query(
    "N4 F4 F5 F6 F14",
    given(more=ORDER_REPORT)
    + f"SELECT 'class_share' AS part, item, n, {r6('100.0 * n / (SELECT sum(n) FROM shares)')} AS value FROM shares"
    + "".join(
        f" UNION ALL SELECT 'nulls', '{c}', count_if({c} IS NULL), {r6(f'100.0 * count_if({c} IS NULL) / count(*)')} FROM taken"
        for c in REPORT_COLUMNS
    )
    + f" UNION ALL SELECT 'missing_text', 'o_orderpriority', NULL, {r6('100.0 * count_if(o_orderpriority IS NULL) / count(*)')} FROM taken",
)
def profile_report_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class shares, NULL counts and missing texts of one report."""
    orders = S.table(spark, sf_dir, "orders").select(*REPORT_COLUMNS).replace("4-NOT SPECIFIED", None, "o_orderpriority")
    report = profile_report(orders, "o_orderstatus", ["P", "F", "O"], ["o_orderkey"])
    parts = {
        "class_share": ("o_orderstatus", "n", "share_pct"), "nulls": ("feature", "nulls", "missing_pct"),
        "missing_text": ("feature", None, "missing_pct"),
    }
    frames = [
        report[part].select(
            F.lit(part).alias("part"), F.col(item).alias("item"),
            (F.col(n) if n else F.lit(None)).cast("bigint").alias("n"), F.col(value).alias("value"),
        )
        for part, (item, n, value) in parts.items()
    ]
    return rounded(frames[0].union(frames[1]).union(frames[2]), "value")


@query(
    "N4 F14",
    given("matrix")
    + "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r6(f'corr({c}, target)')} AS correlation FROM matrix" for c in S.FEATURES)
    + ") WHERE correlation > 0.015",
)
def profile_report_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = profile_report(S.activity_matrix(spark, sf_dir), "target", [1], KEYS)
    return rounded(report["correlation"], "correlation")


@query("N5 J9 J10 F11")
def selection_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    train_side = samples(rows)["train"]
    chosen = {
        "importance": select_features(train_side, S.FEATURES, "target", "importance", size=9, seed=1),
        "collinearity": select_features(train_side, S.FEATURES, "target", "collinearity", limit=5.0),
        "information": select_features(train_side, S.FEATURES, "target", "information", top=12),
    }
    rows_out = [(method, name) for method, names in chosen.items() for name in names]
    return spark.createDataFrame(rows_out, "method string, feature string")


@query("N6 I3 I4 I5")
def training_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev = matrix(spark, sf_dir).filter(F.col("sample") == "dev").drop("sample")
    done = train(dev, S.FEATURES, "target", KEYS, "balanced_forest")
    sides = {"train": done.train, "test": done.test}
    return score_and_evaluate(done.model, sides, "target", KEYS)["scores"]


@query("N7 J8 J13 G6")
def evaluation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    dev = rows.filter(F.col("sample") == "dev").drop("sample")
    done = train(dev, S.FEATURES, "target", KEYS, "logistic")
    later = {n: rows.filter(F.col("sample") == n).drop("sample") for n in ("oot1", "oot2")}
    sides = {"train": done.train, "test": done.test, **later}
    return score_and_evaluate(done.model, sides, "target", KEYS)["gains"]


@query("N3 N6 N7 H7 J13")
def development_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the years up to 1998, evaluate on both sides of the split and on two later samples."""
    rows = _unprepared(spark, sf_dir)
    year = F.col("day")
    later = {"oot1": rows.filter((year > "1998") & (year <= "1999")), "oot2": rows.filter(year > "1999")}
    done = develop(rows.filter(year <= "1998"), later, PREPARED_FEATURES, S.PREP, "boosted_trees")
    return done.tables["report"]


@query("N8 K1 K2 K3 K4")
def explanation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir)
    dev = model_matrix(rows.filter(F.col("sample") == "dev"), S.FEATURES, "target", KEYS)
    done = train(dev, S.FEATURES, "target", KEYS, "boosted_trees")
    tables = explain(done.model, rows, S.FEATURES, KEYS)
    return tables["importance"].join(tables["split_counts"], "feature").join(tables["mean_absolute"], "feature")
