"""Jobs on hand-made tables with the default codes, and the shape of physical plans."""

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plans import count_nodes, plan_text
from planshift.operators.joins import drop_copies, join_recent, period_pair
from planshift.operators.ranking import global_rank
from planshift.plans.dataset import DatasetSpec, build_dataset
from planshift.plans.labels import LabelSpec, build_labels, distinct_pairs, tier_changes
from planshift.plans.prepare import PrepSpec, fit_prep, prepare, training_matrix
from planshift.plans.report import profile_report
from planshift.session import shared_folder, work_path
from planshift.sources import standins as S
from planshift.sources.tables import (
    dated_partitions,
    lower_names,
    materialize,
    previous_month,
    read_table,
    replace_partitions,
    snapshot,
)

STARTER, PREFERRED, ECONOMY, BASIC = (
    "DIGITAL STARTER VIDEO", "DIGITAL PREFERRED VIDEO", "DIGITAL ECONOMY VIDEO", "BASIC VIDEO",
)


def day(n, month=9):
    return dt.date(2019, month, n)


@pytest.fixture(scope="module")
def snaps(spark):
    def row(account, ym, tier, status="ACT", video=1, products=2, residential=1, gone=0, courtesy=0):
        return (account, ym, tier, status, video, products, residential, gone, courtesy)

    rows = [
        row(1, "201908", STARTER), row(1, "201909", PREFERRED),
        row(2, "201908", PREFERRED), row(2, "201909", STARTER),
        row(3, "201908", "OTHER"), row(3, "201909", PREFERRED),
        row(4, "201908", BASIC), row(4, "201909", STARTER, courtesy=None),
        row(5, "201909", PREFERRED),
        row(6, "201908", BASIC), row(6, "201909", ECONOMY),
        row(7, "201908", BASIC, products=0), row(7, "201909", ECONOMY),
    ]
    return spark.createDataFrame(
        rows,
        "account_id int, ym string, tier string, status string, video_units int, product_count int, residential int, "
        "disconnected int, courtesy int",
    )


SPEC = LabelSpec("201909", previous_month("201909"), dt.date(2019, 9, 20), dt.date(2019, 10, 23))


@pytest.fixture(scope="module")
def sold(spark):
    def row(account, d, channel="WebDotCom", task="Tier Change - Upgrade X", sub="VideoU"):
        return (account, account * 10, d, channel, task, sub, "VIDEO/HSD")

    rows = [
        row(1, day(20)), row(1, day(20)), row(1, day(19)), row(1, day(23, 10)), row(1, day(22, 10)),
        row(2, day(25)), row(3, day(25)), row(4, day(25)), row(6, day(25)), row(6, day(26), channel="dot"),
        row(6, day(27), task="A Tier Change - Upgrade"), row(6, day(28), sub="VideoD"), row(7, day(25)),
    ]
    return spark.createDataFrame(
        rows, "account_id int, account_number int, day date, channel string, task string, sub_task string, product_mix string"
    )


def test_labels(snaps, sold):
    found = build_labels(sold, snaps, SPEC).collect()
    got = sorted((r["account_id"], r["day"], r["year_month"], r["tier_from"], r["tier_to"]) for r in found)
    assert got == [
        (1, day(20), "201909", STARTER, PREFERRED),
        (1, day(22, 10), "201910", STARTER, PREFERRED),
        (6, day(25), "201909", BASIC, ECONOMY),
    ]
    flags = {r["account_id"]: r["upgraded"] for r in tier_changes(snaps, SPEC).collect()}
    assert flags == {1: 1, 2: 0, 3: 0, 6: 1}


def test_previous_month():
    assert [previous_month(m) for m in ("201909", "202001")] == ["201908", "201912"]


@pytest.fixture(scope="module")
def dataset(spark, snaps, sold):
    labels = build_labels(sold, snaps, SPEC)
    visits = spark.createDataFrame(
        [(1, day(20), 3), (1, day(18), 1), (1, day(17), 9), (1, day(21), 9), (6, day(24), 2)],
        "account_id int, visit_day date, total_visits int",
    )
    daily = spark.createDataFrame(
        [(1, 2019, 9, 20, 5, 7), (1, 2019, 9, 18, 6, None), (6, 2019, 9, 24, 8, 1), (6, 2019, 13, 1, 0, 0), (1, 2018, 9, 20, 1, 1)],
        "account_id int, year int, month int, date int, pages_l7d int, total_visits int",
    )
    flags = spark.createDataFrame(
        [(1, day(20), "Y"), (1, day(20), "Y"), (6, day(24), "N")], "account_id int, visit_day date, page_flag string"
    )
    attributes = spark.createDataFrame([(1, 90.0, "VIDEO ONLY"), (6, 3.0, None)], "account_id int, tenure_by_account double, product_mix string")
    return build_dataset(labels, visits, daily, flags, flags, attributes, DatasetSpec(2019, 8))


def test_dataset(dataset):
    rows = sorted(
        (r["account_id"], r["visit_day"], r["total_visits"], r["total_visits_daily"], r["pages_l7d"], r["page_flag"], r["page_flag_m"], r["tenure_by_account"])
        for r in dataset.collect()
    )
    assert rows == [
        (1, day(18), 1, None, 6, None, None, 90.0),
        (1, day(20), 3, 7, 5, "Y", "Y", 90.0),
        (6, day(24), 2, 1, 8, "N", "N", 3.0),
    ]
    mixes = {r["account_id"]: r["product_mix"] for r in dataset.collect()}
    assert mixes == {1: "VIDEO ONLY", 6: None}  # the attribute, not the mix of the sale


def leaves(df):
    """The scans of the plan that ran, without adaptive execution."""
    found = df._jdf.queryExecution().executedPlan().collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def test_dataset_reads_the_label_days_alone(spark, tmp_path):
    parts = [(a, 2024, m, d, a + d) for a in range(4) for m in (1, 2, 3) for d in range(1, 29)]
    daily = spark.createDataFrame(parts, "account_id int, year int, month int, date int, pages int")
    daily = materialize(daily.union(daily), str(tmp_path / "daily"), ("year", "month", "date"))
    labels = spark.createDataFrame([(1, dt.date(2024, 2, 3)), (2, dt.date(2024, 3, 1))], "account_id int, day date")
    visits = spark.createDataFrame([(a, dt.date(2024, 2, d), 1) for a in (1, 2) for d in (1, 2, 3, 28)], "account_id int, visit_day date, visits int")
    flags = spark.createDataFrame([(1, dt.date(2024, 2, 2), "Y")] * 2, "account_id int, visit_day date, page_flag string")
    attributes = spark.createDataFrame([(1, 5), (1, 5)], "account_id int, tenure int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = build_dataset(labels, visits, daily, flags, flags, attributes, DatasetSpec(2024, 1))
        rows = sorted((r["account_id"], r["visit_day"].day, r["pages"], r["page_flag"], r["tenure"]) for r in made.collect())
        assert rows == [(1, 1, 2, None, 5), (1, 2, 3, "Y", 5), (1, 3, 4, None, 5), (2, 28, 30, None, None)]
        assert "dynamicpruning" in plan_text(made)
        # three days before the first sale, and the 28th for the second: 29 February and 1 March hold nothing or no visit
        read = [n.metrics().apply("numPartitions").value() for n in leaves(made) if n.metrics().contains("numPartitions")]
        assert read == [5]
        tree = plan_text(made, "simple")
        shuffles = re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", tree)
        keys = sorted(re.sub(r"#\d+L?", "", k) for k in shuffles)
        # labels and visits, daily rows, two flag tables by (account, day); labels and attributes by account; the wanted days
        assert keys == sorted(["account_id"] * 2 + ["account_id, visit_day"] * 4 + ["_daily_key, daily_day", "_day", "day"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_copies_are_dropped_by_key(spark):
    rows = [(1, 1.0, "a"), (1, 1.0, "a"), (1, None, "a"), (1, None, "a"), (None, None, None), (None, None, None), (2, float("nan"), ""), (2, float("nan"), "")]
    df = spark.createDataFrame(rows, "k int, x double, t string").repartition(3)
    assert sorted(map(str, drop_copies(df, ["k"]).collect())) == sorted(map(str, df.distinct().collect()))
    assert drop_copies(df.select("k"), ["k"]).count() == 3


def test_labels_read_the_snapshots_once(spark, snaps, sold):
    def pairs(df):
        return sorted(map(str, df.select(sorted(df.columns)).collect()))

    twice = snaps.unionByName(snaps).unionByName(snaps.withColumn("tier", F.lit("other")))
    assert pairs(distinct_pairs(twice, SPEC)) == pairs(period_pair(twice, SPEC.current, SPEC.previous).distinct())
    labels = build_labels(sold, snaps, SPEC)
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", plan_text(labels, "simple"))) == 1


@pytest.mark.parametrize("kind", ["path", "table"])
def test_a_month_written_twice(spark, tmp_path, kind):
    target = str(tmp_path / "months") if kind == "path" else "months_written"
    rows = spark.createDataFrame([(m, i, f"{m}{i}") for m in ("201908", "201909", "201910") for i in range(3)], "ym string, id int, t string")
    spark.sql("DROP TABLE IF EXISTS months_written")
    for month in ("201908", "201909", "201910", "201909"):
        whole = replace_partitions(rows.filter(F.col("ym") == month), target, ("ym",))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows.collect()))
    fewer = replace_partitions(rows.filter("ym = '201909' AND id = 1").withColumn("t", F.lit("new")), target, ("ym",))
    assert sorted(map(tuple, fewer.collect())) == sorted(
        [tuple(r) for r in rows.filter("ym <> '201909'").collect()] + [("201909", 1, "new")]
    )
    spark.sql("DROP TABLE IF EXISTS months_written")


def test_preparation(dataset):
    spec = PrepSpec(keys=("account_id", "visit_day"))
    done = prepare(dataset, spec).orderBy("visit_day").collect()
    assert len(done) == 2  # the rare class is gone
    second = done[1].asDict()
    assert (second["target"], second["prev_video_tier_name_enc"], second["productmix"]) == (1, 1.0, 1.0)
    assert (second["tenure_by_account"], second["page_flag"], second["total_visits_daily"]) == (75.0, 1.0, 7.0)
    assert (done[0]["page_flag"], done[0]["total_visits_daily"]) == (0.0, 0.0)
    kept = prepare(dataset, PrepSpec(keys=("account_id", "visit_day"), class_codes={PREFERRED: 1, STARTER: 2, ECONOMY: 3}))
    assert sorted(r["target"] for r in kept.collect()) == [1, 1, 3]


def test_pinned_types_hold_for_later_months(spark):
    spec = PrepSpec(keys=("k",), cap_column="t")
    schema = "k int, tier_to string, tier_from string, product_mix string, t double, v string, w string"
    dev = spark.createDataFrame([(1, PREFERRED, STARTER, "VIDEO ONLY", 80.0, "3", "x")], schema)
    later = spark.createDataFrame([(2, STARTER, None, None, None, "bad", "7")], schema)
    fitted = fit_prep(dev, spec)
    assert dict(prepare(dev, fitted).dtypes) == dict(prepare(later, fitted).dtypes)
    row = prepare(later, fitted).first()
    assert (row["v"], row["w"], row["target"], row["prev_video_tier_name_enc"]) == (None, "7", 0, 3.0)


def test_training_matrix_collapses_equal_rows(spark):
    df = spark.createDataFrame([(3, 1.0, 1), (2, 1.0, 1), (4, 1.0, 0)], "k int, f double, target int")
    rows = training_matrix(df, ["f"], PrepSpec(keys=("k",))).collect()
    assert sorted((r["k"], r["target"]) for r in rows) == [(2, 1), (4, 0)]
    assert training_matrix(df, ["f"], PrepSpec(keys=("k",)), distinct=False).count() == 3


def test_report_tables(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1), (2, "b", None, 0), (3, None, 2.0, 1)], "k int, t string, n double, y int")
    tables = profile_report(df, "y", [1], ["k"])
    assert {name for name in tables} == {"class_share", "nulls", "numeric", "correlation", "missing_text", "evidence", "information_value"}
    assert tables["numeric"].first()["n"] == 2
    assert tables["missing_text"].first()["missing_pct"] == pytest.approx(100 / 3)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 2019, "01", 5), (2, 2019, "02", 6)], "Id int, year int, month string, Val int")
    assert lower_names(df).columns == ["id", "year", "month", "val"]
    stored = materialize(lower_names(df), str(tmp_path / "t"), ("year", "month"))
    assert sorted(map(tuple, stored.collect())) == [(1, 2019, "01", 5), (2, 2019, "02", 6)]
    assert "PartitionFilters: [isnotnull(month" in plan_text(snapshot(stored, "02", "month"))
    named = materialize(lower_names(df), "stored_table")
    assert named.count() == read_table(spark, "stored_table").count() == 2


def test_date_parts_prune_partitions(spark, small, tmp_path):
    stored = materialize(S.with_date_parts(S.daily(spark, small)), str(tmp_path / "d"), ("year", "month", "date"))
    text = plan_text(dated_partitions(stored, 2024, 1, 7))
    for wanted in ("(year", "(month", "(date"):
        assert wanted in text.split("PartitionFilters:")[1].split("\n")[0]


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert Path(named).name in shared_folder(spark)
    assert work_path(spark, "x") != work_path(spark, "x")


# --- plans ---------------------------------------------------------------------------------


def test_label_filters_reach_the_scan(spark, small):
    text = plan_text(build_labels(S.sales(spark, small), S.snapshots(spark, small), S.LABELS))
    assert "EqualTo(l_returnflag,R)" in text
    assert "GreaterThanOrEqual(l_shipdate" in text or "cast(l_shipdate" in text
    assert "StringStartsWith(p_brand,Brand#1)" in text and "StringContains(p_name,o)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_bucketed_tables_join_without_shuffle(spark, small):
    daily = S.daily(spark, small).withColumnRenamed("day", "visit_day")
    keys = ["account_id", "visit_day"]
    a = materialize(S.visits(spark, small), "visits_by_key", bucket_by=keys, buckets=4)
    b = materialize(daily, "daily_by_key", bucket_by=keys, buckets=4)
    joined = a.hint("merge").join(b, keys)
    assert count_nodes(joined, "Exchange") == 0
    assert joined.count() == a.count()


def test_writing_is_rebalanced(spark, small):
    hinted = S.daily(spark, small).hint("rebalance", "day")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan_text(hinted)


def test_exploded_interval_join_is_an_equi_join(spark, small):
    df = join_recent(S.purchase_days(spark, small), S.visits(spark, small).hint("merge"), "account_id", "day", "visit_day")
    text = plan_text(df)
    assert "SortMergeJoin Inner" in text and "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def test_grouped_flags_are_not_deduplicated_again(spark, small):
    flags = S.flags(spark, small, "web")
    assert count_nodes(flags.distinct(), "Exchange") == count_nodes(flags, "Exchange") == 1


def test_rank_uses_no_window_over_rows(spark, small):
    orders = S.table(spark, small, "orders").select("o_orderkey", "o_totalprice")
    ranked = global_rank(orders, [F.col("o_totalprice"), F.col("o_orderkey")])
    tree = plan_text(ranked).split("\n\n")[0]
    window = tree.index("Window")
    assert "HashAggregate" in tree[window:]  # windows run over piece counts only
    assert "SortMergeJoin" not in tree


PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas")


def test_python_workers_see_contributions_only(spark, small):
    for build in (S.snapshots, S.sales, S.daily_wide, S.activity_matrix, S.formula_scores):
        text = plan_text(build(spark, small))
        assert not any(node in text for node in PYTHON_NODES)


def test_library_never_pulls_rows_to_the_driver():
    root = Path(__file__).resolve().parents[1] / "planshift"
    for path in root.rglob("*.py"):
        source = path.read_text()
        for banned in (".toPandas(", "localCheckpoint", ".crossJoin(", ".rdd", "toLocalIterator"):
            assert banned not in source, (path, banned)
