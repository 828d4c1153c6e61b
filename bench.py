"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR   folder of the parquet tables  (default /root/testdata/sf0.1)
BENCH_CPUS     local cores                   (default 8)
BENCH_QUERIES  comma-separated names         (default: the list below)
BENCH_RUNS     runs of a query, the median counts; one that takes over 5 seconds runs once (default 3)
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from planshift.catalog import ENTRIES
from planshift.session import build_session

HEADLINE = [
    # joins and labels
    "label_job", "dataset_job", "recent_visits_exploded", "recent_visits_bucketed", "daily_row_join",
    "triple_enrichment", "spread_hot_keys", "period_self_join",
    # features, cleaning and profiles
    "trailing_activity", "all_columns_but", "prepare_job", "training_matrix_job", "cast_numeric_columns",
    "numeric_profile_lines", "exact_quantile_table", "weight_of_evidence", "woe_lookup", "label_encoding",
    "target_correlation", "inflation_of_all",
    # ranking and evaluation
    "global_row_rank", "gains_overall", "gains_by_sample", "gains_by_class", "formula_report_by_sample",
    # fits, selection and explanation
    "logistic_scores", "balanced_forest_scores", "boosted_tree_scores", "neural_scores",
    "features_by_elimination", "features_by_collinearity", "tree_contributions", "evaluation_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "planshift-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # first use of the session, readers, code generator, trainers and Python workers is not part of any query
    for name in ("frame_shape", "score_deciles", "one_split_mean_absolute"):
        ENTRIES[name].build(spark, folder).collect()

    seconds = {}
    for name in names:
        taken = []
        while len(taken) < runs and (not taken or taken[0] < 5):
            start = time.perf_counter()
            result = ENTRIES[name].build(spark, folder)
            # the whole result is computed: no column is pruned away
            result.write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
