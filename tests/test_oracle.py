"""Every registered query against its SQL twin on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as driver
from planshift.catalog import ENTRIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value.isoformat() if isinstance(value, dt.datetime) else repr(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    found = duck.execute(SQL[name])
    types = {d[0]: str(d[1]) for d in found.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(types)
    place = [list(types).index(c) for c in columns]
    expected = sorted(tuple(_cell(row[i]) for i in place) for row in found.fetchall())
    actual = sorted(tuple(_cell(row[c]) for c in columns) for row in df.collect())
    assert actual == expected


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_every_query_without_sql_depends_on_a_fit_or_matrix_algebra():
    assert {name for name, e in ENTRIES.items() if e.sql is None} == {
        "inflation_of_all", "forest_importance", "balanced_forest_scores", "boosted_tree_scores",
        "deep_boosted_tree_scores", "logistic_scores", "neural_scores", "class_model_scores", "class_model_gains",
        "features_by_elimination", "features_by_collinearity", "features_by_genetic_search",
        "model_report_by_sample", "families_compared", "gain_importance", "split_count_importance",
        "tree_contributions", "selection_job", "training_job", "evaluation_job", "explanation_job",
        "development_job", "penalised_network_scores",
    }
