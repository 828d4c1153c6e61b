"""Aggregations and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.catalog.registry import query
from planshift.catalog.sql_parts import given
from planshift.functions.fixed_values import CORRELATION_FLOOR
from planshift.operators import encoding as N
from planshift.operators import profile as P
from planshift.operators.collinearity import variance_inflation
from planshift.operators.metrics import class_report, confusion_matrix, macro_metrics, normalized_rows
from planshift.operators.ranking import exact_quantiles, heaviest, sort_down
from planshift.sources import standins as S

PROFILED = ["product_count", "video_units", "residential", "courtesy"]
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


@query("F1", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distinct_rows(S.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query("F2 B8", given("matrix") + f"SELECT DISTINCT {', '.join(S.FEATURES)}, target FROM matrix")
def distinct_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distinct_rows(S.activity_matrix(spark, sf_dir), [*S.FEATURES, "target"])


@query("F3", given("snap") + "SELECT courtesy, count(*) AS n FROM snap WHERE courtesy IS NOT NULL GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_counts(S.snapshots(spark, sf_dir), "courtesy")


@query(
    "F4",
    "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share_pct "
    "FROM events GROUP BY 1",
)
def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.class_share(S.table(spark, sf_dir, "events"), "event_type"), "share_pct")


def _nulls_sql(columns, table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS nulls, "
        f"round(100.0 * (count(*) - count({c})) / count(*), 6) + 0.0 AS missing_pct FROM {table}"
        for c in columns
    )


@query("F5", given("wide") + _nulls_sql(["web_view_l3d", "since_last", "total_error"], "wide"))
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = S.daily_wide(spark, sf_dir)
    return rounded(P.null_counts(wide, ["web_view_l3d", "since_last", "total_error"]), "missing_pct")


@query("F5", given("snap") + _nulls_sql(["courtesy"], "snap"))
def columns_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.columns_with_nulls(S.snapshots(spark, sf_dir)), "missing_pct")


@query(
    "F6",
    given("visits", "attrs", more={
        "met": "SELECT mix, CAST(NULLIF(mix, 'BUILDING') AS VARCHAR) AS part FROM visits v "
               "LEFT JOIN attrs a ON v.account_id = a.account_id"
    })
    + "SELECT 'mix' AS feature, round(100.0 * (count(*) - count(mix)) / count(*), 6) + 0.0 AS missing_pct FROM met "
    "UNION ALL SELECT 'part', round(100.0 * (count(*) - count(part)) / count(*), 6) + 0.0 FROM met",
)
def missing_text_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = S.visits(spark, sf_dir).join(S.attributes(spark, sf_dir), "account_id", "left")
    texts = met.select("mix", F.nullif("mix", F.lit("BUILDING")).alias("part"), "pages")
    return rounded(P.missing_text(texts), "missing_pct")


def profile_sql(columns, table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, {r6(f'quantile_cont({c}, 0.25)')} AS q25, "
        f"{r6(f'quantile_cont({c}, 0.5)')} AS q50, {r6(f'quantile_cont({c}, 0.75)')} AS q75, "
        f"CAST(max({c}) AS DOUBLE) AS max, {r6(f'CAST(max({c}) - min({c}) AS DOUBLE)')} AS max_min, "
        f"{r6(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_pct FROM {table}"
        for c in columns
    )


PROFILE_ROUNDED = ("mean", "std", "q25", "q50", "q75", "max_min", "missing_pct")


@query("F7", given("snap") + profile_sql(PROFILED, "snap"))
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.numeric_profile(S.snapshots(spark, sf_dir), PROFILED, "exact"), *PROFILE_ROUNDED)


@query("F7", profile_sql(LINE_COLUMNS, "lineitem"))
def numeric_profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.numeric_profile(S.table(spark, sf_dir, "lineitem"), LINE_COLUMNS, "exact"), *PROFILE_ROUNDED)


@query(
    "F7",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(f'quantile_cont({c}, 0.1)')} AS q10, {r6(f'quantile_cont({c}, 0.99)')} AS q99 "
        "FROM orders"
        for c in ("o_totalprice", "o_custkey")
    ),
)
def exact_quantile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    return rounded(exact_quantiles(orders, ["o_totalprice", "o_custkey"], [0.1, 0.99]), "q10", "q99")


@query(
    "F8",
    given("attrs", more={
        "edges": "SELECT min(tenure)::DOUBLE AS lo, (max(tenure) - min(tenure)) / 10.0::DOUBLE AS w FROM attrs",
        "bins": "SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS bin",
        "placed": "SELECT CAST(least(floor((tenure - lo) / w), 9) + 1 AS INTEGER) AS bin FROM attrs CROSS JOIN edges",
    })
    + "SELECT b.bin, round(any_value(lo + (b.bin - 1) * w), 6) + 0.0 AS bin_from, count(p.bin) AS n "
    "FROM bins b CROSS JOIN edges LEFT JOIN placed p ON p.bin = b.bin GROUP BY b.bin",
)
def tenure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.histogram(S.attributes(spark, sf_dir), "tenure"), "bin_from")


# --- tables of evidence over the three order states, one class against the rest ----------

STATES = ("P", "F", "O")
CATEGORIES = ("o_orderpriority", "order_year")
EVIDENCE = {
    "long": "SELECT 'o_orderpriority' AS variable, o_orderpriority AS value, o_orderstatus AS c FROM orders "
            "UNION ALL SELECT 'order_year', CAST(year(o_orderdate) AS VARCHAR), o_orderstatus FROM orders",
    "cells": "SELECT variable, value, k AS class, count(*) FILTER (WHERE c = k) AS events, "
             "count(*) FILTER (WHERE c <> k) AS non_events FROM long CROSS JOIN (SELECT unnest(['P', 'F', 'O']) AS k) "
             "GROUP BY 1, 2, 3",
    "shared": "SELECT *, events / sum(events) OVER (PARTITION BY variable, class) AS event_share, "
              "non_events / sum(non_events) OVER (PARTITION BY variable, class) AS non_event_share FROM cells",
    "evidence": "SELECT variable, value, avg(event_share) AS event_pct, avg(non_event_share) AS non_event_pct, "
                "ln((avg(event_share) + 0.001) / (avg(non_event_share) + 0.001)) AS woe FROM shared GROUP BY 1, 2",
}


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "orders").select(
        "o_orderpriority", F.year("o_orderdate").alias("order_year"), "o_orderstatus"
    )


@query(
    "F9 I2",
    given(more=EVIDENCE)
    + f"SELECT variable, value, class, events, non_events, {r6('event_share')} AS event_share, "
    f"{r6('non_event_share')} AS non_event_share FROM shared",
)
def class_cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = N.category_shares(_categories(spark, sf_dir), CATEGORIES, "o_orderstatus", STATES)
    return rounded(shares, "event_share", "non_event_share")


@query(
    "F10",
    given(more=EVIDENCE)
    + f"SELECT variable, value, {r6('event_pct')} AS event_pct, {r6('non_event_pct')} AS non_event_pct, "
    f"{r6('woe')} AS woe, {r6('(event_pct - non_event_pct) * woe')} AS iv FROM evidence",
)
def weight_of_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = N.weight_of_evidence(_categories(spark, sf_dir), CATEGORIES, "o_orderstatus", STATES)
    return rounded(table, "event_pct", "non_event_pct", "woe", "iv")


@query(
    "F10",
    given("matrix", more={
        "cells": "SELECT mix_code, count(*) FILTER (WHERE target = 1) AS e, count(*) FILTER (WHERE target = 0) AS ne "
                 "FROM matrix GROUP BY 1",
        "shared": "SELECT mix_code, e / sum(e) OVER () AS e, ne / sum(ne) OVER () AS ne FROM cells",
    })
    + "SELECT 'mix_code' AS variable, CAST(mix_code AS VARCHAR) AS value, "
    f"{r6('ln((e + 0.001) / (ne + 0.001))')} AS woe, {r6('(e - ne) * ln((e + 0.001) / (ne + 0.001))')} AS iv FROM shared",
)
def binary_weight_of_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = N.weight_of_evidence(S.activity_matrix(spark, sf_dir), ["mix_code"], "target", [1])
    return rounded(table, "woe", "iv").select("variable", "value", "woe", "iv")


@query(
    "F11 G7",
    given(more=EVIDENCE)
    + f"SELECT variable, {r6('sum((event_pct - non_event_pct) * woe)')} AS iv FROM evidence GROUP BY 1 ORDER BY 2 DESC",
)
def information_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = N.weight_of_evidence(_categories(spark, sf_dir), CATEGORIES, "o_orderstatus", STATES)
    return N.information_value(table).withColumn("iv", F.round("iv", 6))


GRID = {"k": "SELECT unnest([0, 1]) AS v", "s": "SELECT DISTINCT sample FROM scored"}


@query(
    "F12",
    given("scored", more={
        **GRID,
        "cells": "SELECT a.v AS actual, b.v AS predicted, count(x.pred) AS n FROM k a CROSS JOIN k b "
                 "LEFT JOIN scored x ON x.target = a.v AND x.pred = b.v GROUP BY 1, 2",
    })
    + f"SELECT *, {r6('n / sum(n) OVER (PARTITION BY actual)')} AS row_share FROM cells",
)
def confusion_row_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = confusion_matrix(S.formula_scores(spark, sf_dir), "target", "pred", (0, 1))
    return rounded(normalized_rows(matrix), "row_share")


REPORT = {
    "k": "SELECT unnest([0, 1]) AS class",
    "hits": "SELECT sample, class, count(*) FILTER (WHERE target = class AND pred = class) AS tp, "
            "count(*) FILTER (WHERE pred = class) AS called, count(*) FILTER (WHERE target = class) AS actual_n "
            "FROM scored CROSS JOIN k GROUP BY 1, 2",
    "report": "SELECT sample, class, actual_n, coalesce(tp / nullif(called, 0), 0.0) AS precision, "
              "coalesce(tp / nullif(actual_n, 0), 0.0) AS recall, "
              "coalesce(2 * tp / nullif(called + actual_n, 0), 0.0) AS f1 FROM hits",
}


@query(
    "F13",
    given("scored", more=REPORT)
    + f"SELECT sample, class, actual_n, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM report",
)
def class_report_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = class_report(S.formula_scores(spark, sf_dir), "target", "pred", (0, 1), ["sample"])
    return rounded(table, "precision", "recall", "f1")


@query(
    "F13",
    given("scored", more=REPORT)
    + f"SELECT (SELECT count(*) FROM scored) AS n, (SELECT {r6('avg(CASE WHEN target = pred THEN 1.0 ELSE 0.0 END)')} "
    f"FROM scored) AS accuracy, {r6('avg(p)')} AS precision, {r6('avg(r)')} AS recall, {r6('avg(f)')} AS f1 FROM ("
    "SELECT class, sum(tp) / sum(called) AS p, sum(tp) / sum(actual_n) AS r, "
    "2 * sum(tp) / (sum(called) + sum(actual_n)) AS f FROM hits GROUP BY class)",
)
def macro_metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = macro_metrics(S.formula_scores(spark, sf_dir), "target", "pred", (0, 1))
    return rounded(table, "accuracy", "precision", "recall", "f1")


@query(
    "F14",
    given("matrix")
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, {r6(f'corr({f}, target)')} AS correlation FROM matrix" for f in S.FEATURES),
)
def target_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.target_correlation(S.activity_matrix(spark, sf_dir), S.FEATURES, "target"), "correlation")


@query(
    "F14",
    given("matrix")
    + "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, {r6(f'corr({f}, target)')} AS correlation FROM matrix" for f in S.FEATURES)
    + ") WHERE correlation > 0.015",
)
def correlation_above_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.activity_matrix(spark, sf_dir)
    return rounded(P.target_correlation(rows, S.FEATURES, "target", CORRELATION_FLOOR), "correlation")


PAIR_VIF = "sum(a * a) * sum(b * b) / (sum(a * a) * sum(b * b) - sum(a * b) * sum(a * b))"


@query(
    "F15 G7",
    f"SELECT unnest(['l_quantity', 'l_discount']) AS feature, {r6(PAIR_VIF)} AS vif "
    "FROM (SELECT l_quantity AS a, l_discount AS b FROM lineitem)",
)
def inflation_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = variance_inflation(S.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return table.select("feature", F.round("vif", 6).alias("vif"))


@query(
    "F15",
    "SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature, "
    f"{r6('1 / (1 - corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice))')} AS vif FROM lineitem",
)
def inflation_of_two_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = variance_inflation(S.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], centred=True)
    return table.select("feature", F.round("vif", 6).alias("vif"))


@query("F15")
def inflation_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variance_inflation(S.activity_matrix(spark, sf_dir), S.FEATURES)


@query(
    "G8 F15",
    "SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
)
def heaviest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = S.table(spark, sf_dir, "lineitem")
    return heaviest(lines.groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity")), "quantity", "l_partkey")


@query("G7", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
def sorted_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    return sort_down(orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "n", "o_custkey")
