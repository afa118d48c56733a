"""What is told about a model's rows comes from stored rows: no aggregate or join has a model in its plan."""

import pytest

from tablecraft.operators import learning
from tablecraft.plans.catalogue import QUERIES, learning as queries


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of all frames of which the first row is asked for."""
    told, kind = [], type(spark.range(1))
    first = kind.first

    def seen(self):
        told.append(self._jdf.queryExecution().executedPlan().toString())
        return first(self)

    monkeypatch.setattr(kind, "first", seen)
    return told


def _rows(spark, target):
    return spark.range(0, 240, 1, 2).selectExpr("id AS doc_id", "id AS o_orderkey", "id AS l_orderkey", "1 AS l_linenumber", "1 AS l_partkey", "1 AS l_suppkey", "id AS l_shipdate",
                                                "cast(id % 17 AS double) AS a", "concat('w', id % 3) AS word", f"{target} AS y")


def _with_model(plans):
    return [plan for plan in plans if "UDF(" in plan]


@pytest.mark.parametrize("target, problem", [("id % 17 * 2 + id % 3", "regression"), ("if(id % 17 > 8, 'many', 'few')", "classification")])
def test_training_scores_stored_rows(spark, plans, target, problem):
    run = learning.train(_rows(spark, target), "y", ["a", "word"], ["doc_id"], problem, ["Decision Tree", "Random Forest"], trees=3)
    assert len(run.rows) == 2 and len(plans) >= 2 and not _with_model(plans)


def test_sums_of_tree_values_join_stored_rows(spark, plans, monkeypatch):
    run = learning.train(_rows(spark, "if(id % 17 > 8, 'many', 'few')"), "y", ["a", "word"], ["doc_id", "o_orderkey"], "classification",
                         ["Decision Tree", "Random Forest", "Gradient Boosting"], trees=3, rounds=3)
    monkeypatch.setattr(queries, "quality_run", lambda t, *models: run)
    monkeypatch.setattr(queries, "class_run", lambda t, *models: run)
    plans.clear()
    rows = QUERIES["ml18_tree_values_sum"](spark, "").collect()
    assert len(rows) == 6 and all(r["different"] == 0 and r["every_row"] for r in rows)
    assert len(plans) == 6 and not _with_model(plans)


@pytest.mark.parametrize("name, maker, target, problem", [("ml05_scores_from_rows", "regression_run", "id % 17 * 2 + id % 3", "regression"),
                                                          ("ml06_scores_from_rows", "quality_run", "if(id % 17 > 8, 'many', 'few')", "classification")])
def test_scores_follow_from_stored_rows(spark, plans, monkeypatch, name, maker, target, problem):
    keys = ["doc_id", *queries.ITEM_KEYS]
    run = learning.train(_rows(spark, target), "y", ["a", "word"], keys, problem, ["Decision Tree", "Random Forest"], trees=3)
    monkeypatch.setattr(queries, maker, lambda t, *models: run)
    plans.clear()
    assert all(r["same"] for r in QUERIES[name](spark, "").collect())
    assert len(plans) == 2 and not _with_model(plans)
