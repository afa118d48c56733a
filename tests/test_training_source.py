"""Training makes its rows once, whatever they come from."""

import uuid

import pytest

from tablecraft.operators import learning


def _counted(spark, folder, rows=400):
    """A table that leaves a file for each time its rows are made."""
    folder.mkdir()

    def made(batches):
        (folder / uuid.uuid4().hex).touch()
        yield from batches

    source = spark.range(0, rows, 1, 1).selectExpr("id AS key", "cast(id % 17 AS double) AS a", "concat('w', id % 3) AS word", "cast(id % 17 * 2 + id % 3 AS double) AS y",
                                                   "id % 3 = 1 AS lane", "NULL AS nothing")
    return source.drop("nothing").mapInPandas(made, "key long, a double, word string, y double, lane boolean").selectExpr("*", "NULL AS nothing")


@pytest.mark.parametrize("target, problem, model", [("y", "regression", "Linear Regression"), ("lane", "classification", "Decision Tree")])
def test_source_is_made_once(spark, tmp_path, target, problem, model):
    run = learning.train(_counted(spark, tmp_path / target), target, ["a", "word", "nothing"], ["key"], problem, [model])
    assert run.train.count() + run.test.count() == 400
    assert len(list((tmp_path / target).iterdir())) == 1


def test_split_is_that_of_the_keys(spark, tmp_path):
    df = _counted(spark, tmp_path / "rows")
    run = learning.train(df, "y", ["a", "word"], ["key"], "regression", ["Linear Regression"])
    inside, outside = learning.hash_split(df, ["key"])
    keys = lambda rows: sorted(r["key"] for r in rows.select("key").collect())
    assert keys(run.train) == keys(inside) and keys(run.test) == keys(outside) and "__train" not in run.train.columns


def test_preprocessing_makes_its_rows_once(spark, tmp_path, monkeypatch):
    from tablecraft.plans.catalogue import QUERIES, learning as queries

    rows = _counted(spark, tmp_path / "items").selectExpr(
        "key AS l_orderkey", "1 AS l_linenumber", "1 AS l_partkey", "1 AS l_suppkey", "key AS l_shipdate", "a AS l_quantity", "a % 5 AS l_discount", "a % 3 AS l_tax",
        "word AS l_returnflag", "a * a AS p_retailprice", "y AS l_extendedprice")
    monkeypatch.setattr(queries, "items", lambda t: rows)
    assert QUERIES["ml02_preprocess"](spark, "").first()["rows"] == 400
    assert len(list((tmp_path / "items").iterdir())) == 1
