"""Every registered query with SQL, beside DuckDB on the smallest tables."""

import duckdb
import pytest

from scripts.check import compare
from tablecraft.plans.catalogue import ORACLE, QUERIES
from tablecraft.plans.catalogue.registry import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    status, _, _, note = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR)
    assert status in ("ok", "ok-empty"), f"{status}: {note}"


@pytest.mark.parametrize("name", ["io16_dataset_catalog", "ml04_linear_regression", "ml11_kmeans_labels", "ml19_scenarios", "ou03_isolation_forest"])
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_names_are_consistent():
    assert set(ORACLE) <= set(QUERIES)
    assert not any("pipeline" in name or name.startswith("op") for name in QUERIES)
