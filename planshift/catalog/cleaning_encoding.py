"""Cleaning, casts, encodings, split and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.catalog.profiles import r6, rounded
from planshift.catalog.registry import query
from planshift.catalog.sql_parts import given
from planshift.operators import cleaning as K
from planshift.operators.encoding import apply_label_codes, label_codes, one_vs_rest
from planshift.operators.sampling import balanced_weight, mark_folds, mark_split, positive_weight
from planshift.sources import standins as S

# Raw cells with every sentinel, made from the tables: order state as a flag, the priority
# digit as text, missing attributes as NULL.
RAW = """
    SELECT o_orderkey,
           CASE o_orderstatus WHEN 'P' THEN 'Y' WHEN 'F' THEN 'N' ELSE 'None' END AS flag,
           CASE WHEN o_orderpriority = '1-URGENT' THEN ' ' WHEN o_orderpriority = '2-HIGH' THEN NULL
                ELSE o_orderpriority[1:1] END AS level,
           CASE WHEN o_totalprice < 250000 THEN o_totalprice END AS amount,
           o_orderpriority AS tier
    FROM orders"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, tier = F.col("o_orderstatus"), F.col("o_orderpriority")
    return S.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(state == "P", "Y").when(state == "F", "N").otherwise("None").alias("flag"),
        F.when(tier == "1-URGENT", " ").when(tier != "2-HIGH", F.substring(tier, 1, 1)).alias("level"),
        F.when(F.col("o_totalprice") < 250000, F.col("o_totalprice")).alias("amount"),
        tier.alias("tier"),
    )


CLEAN = (
    "SELECT o_orderkey, CASE flag WHEN 'Y' THEN '1' ELSE '0' END AS flag, "
    "CASE WHEN level IS NULL OR level = ' ' THEN '0' ELSE level END AS level, "
    "coalesce(amount, 0) AS amount, tier FROM raw"
)


@query("H1", given(more={"raw": RAW}) + CLEAN)
def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.clean_cells(_raw(spark, sf_dir))


@query(
    "H2 H4",
    given(more={"raw": RAW})
    + "SELECT o_orderkey, flag, CASE WHEN level IS NULL OR level = ' ' THEN 'NA' ELSE level END AS level, "
    "coalesce(amount, 0) AS amount, tier FROM raw",
)
def fill_zero_and_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.fill_by_type(_raw(spark, sf_dir), blank_is_missing=True)


@query(
    "H3",
    given(more={"raw": RAW})
    + "SELECT o_orderkey, flag, coalesce(level, 'NA') AS level, coalesce(amount, 99999) AS amount, tier FROM raw",
)
def fill_far_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.fill_sentinel(_raw(spark, sf_dir))


@query("H5", given(more={"raw": RAW}) + "SELECT o_orderkey, CASE flag WHEN 'Y' THEN 1 ELSE 0 END AS target FROM raw")
def label_to_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = K.clean_cells(_raw(spark, sf_dir))
    return cleaned.select("o_orderkey", F.col("flag").cast("int").alias("target"))


@query(
    "H6",
    given(more={"raw": RAW, "clean": CLEAN})
    + "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(flag AS DOUBLE) AS flag, CAST(level AS DOUBLE) AS level, "
    "amount, tier FROM clean",
)
def cast_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.auto_numeric(K.clean_cells(_raw(spark, sf_dir)))


@query(
    "I1 E6",
    given(more={
        "names": "SELECT p_partkey, upper(p_name) AS p_name, upper(p_brand) AS p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part",
    })
    + 'SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS "p_name_LE", '
    'dense_rank() OVER (ORDER BY p_brand) - 1 AS "p_brand_LE", dense_rank() OVER (ORDER BY p_size) - 1 AS "p_size_LE" '
    "FROM names",
)
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = S.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    variables = ["p_name", "p_brand", "p_size"]
    coded = apply_label_codes(part, label_codes(part, variables), variables)
    return coded.select("p_partkey", *[f"{v}_LE" for v in variables])


@query(
    "I1",
    "SELECT 'p_type' AS variable, upper(p_type) AS value, row_number() OVER (ORDER BY upper(p_type)) - 1 AS code "
    "FROM (SELECT DISTINCT p_type FROM part) UNION ALL "
    "SELECT 'p_brand', upper(p_brand), row_number() OVER (ORDER BY upper(p_brand)) - 1 FROM (SELECT DISTINCT p_brand FROM part)",
)
def label_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_codes(S.table(spark, sf_dir, "part"), ["p_type", "p_brand"])


@query(
    "I2",
    "SELECT o_orderkey, o_orderstatus, "
    + ", ".join(f'CASE WHEN o_orderstatus = \'{s}\' THEN 1 ELSE 0 END AS "is_{s}"' for s in "PFO")
    + " FROM orders",
)
def one_vs_rest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return one_vs_rest(orders, "o_orderstatus", ["P", "F", "O"])


HASH = "('0x' || substr(md5(account_id || '|' || strftime(day, '%Y-%m-%d') || '|{seed}'), 1, 8))::BIGINT / 4294967296.0"


@query(
    "I3",
    given("matrix")
    + f"SELECT account_id, day, CASE WHEN {HASH.format(seed=3)} < 0.2 THEN 'test' ELSE 'train' END AS split FROM matrix",
)
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_split(S.activity_matrix(spark, sf_dir).select("account_id", "day"), ["account_id", "day"])


@query(
    "I3",
    given("matrix") + f"SELECT account_id, day, CAST(floor({HASH.format(seed=5)} * 3) AS INTEGER) AS fold FROM matrix",
)
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["account_id", "day"]
    return mark_folds(S.activity_matrix(spark, sf_dir).select(*keys), keys, 3, 5)


@query(
    "I5",
    given("matrix")
    + "SELECT account_id, day, CASE WHEN target = 1 THEN 0.647322::DOUBLE ELSE 1.0::DOUBLE END AS w_positive, "
    + r6("count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY target))")
    + " AS w_balanced FROM matrix",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.activity_matrix(spark, sf_dir).select("account_id", "day", "target")
    weighted = balanced_weight(positive_weight(rows, "target", name="w_positive"), "target", (0, 1), "w_balanced")
    return rounded(weighted, "w_balanced").drop("target")
