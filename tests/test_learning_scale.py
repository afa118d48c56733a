"""Steps that must not gather rows in one task or be worked out again, and their results beside plain ways to get them."""

import numpy as np
import pytest
from pyspark.ml.feature import Imputer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablecraft.operators import joining, learning, recommend, tree_values
from tablecraft.operators.quantiles import column_medians


def _rows(spark, n=400):
    return spark.range(n).select(
        F.col("id").alias("key"), F.when(F.col("id") % 7 != 0, F.sqrt("id")).alias("a"),
        F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.pmod(F.col("id") * 37, F.lit(101)).cast("double")).alias("b"),
        F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("word"),
        (F.col("id") * 2.0 + F.pmod(F.col("id") * 37, F.lit(101))).alias("target"))


def test_medians_are_those_of_an_imputer_without_error(spark):
    for n in (1, 2, 9, 10, 401):
        rows = _rows(spark, n).withColumn("c", F.lit(-2.5))
        some = [c for c in "abc" if rows.where(F.col(c).isNotNull() & ~F.isnan(c)).count()]
        plain = Imputer(strategy="median", relativeError=0.0, inputCols=some, outputCols=[f"{c}_" for c in some]).fit(rows)
        assert column_medians(rows, some) == plain.surrogateDF.select(*some).first().asDict()
    assert column_medians(rows.where("false"), ["a"]) == {"a": None}


def test_features_are_not_imputed_by_a_sketch_that_holds_every_value(spark):
    stages = learning.feature_stages(_rows(spark), ["a", "b", "word"])
    assert not any(isinstance(stage, Imputer) for stage in stages)


def test_features_are_fitted_once_for_all_candidates(spark, monkeypatch):
    fits = []
    own = learning.column_medians
    monkeypatch.setattr(learning, "column_medians", lambda df, names: fits.append(names) or own(df, names))
    run = learning.train(_rows(spark), "target", ["a", "b", "word"], ["key"], "regression", ["Linear Regression", "Ridge Regression", "Decision Tree"])
    assert len(run.models) == 3 and fits == [["a", "b"]]


def test_folds_are_told_without_python_rows(spark):
    rows = learning.prepare(_rows(spark), ["a", "b"], "target", "regression", ["key"]).withColumnRenamed("label_raw", "label")
    found = learning.cross_validate(rows, ["a", "b"], ["key"], LinearRegression(), "regression").first()
    x = rows.withColumn("fold", F.pmod(F.xxhash64("key", F.lit(learning.SEED)), F.lit(5))).toPandas()
    scores = []
    for i in range(5):
        fit, held = x[x["fold"] != i], x[x["fold"] == i]
        middle = {c: fit[c].dropna().sort_values().iloc[(fit[c].count() - 1) // 2] for c in "ab"}
        design = lambda d: np.column_stack([np.ones(len(d)), *[d[c].fillna(middle[c]) for c in "ab"]])
        weights = np.linalg.lstsq(design(fit), fit["label"], rcond=None)[0]
        error = held["label"] - design(held) @ weights
        scores.append(1 - (error ** 2).sum() / ((held["label"] - held["label"].mean()) ** 2).sum())
    assert found["metric"] == "r2"
    assert found["mean"] == pytest.approx(np.mean(scores)) and found["std"] == pytest.approx(np.std(scores))


def test_empty_folds_are_refused(spark):
    rows = learning.prepare(_rows(spark, 1), ["a"], "target", "regression", ["key"]).withColumnRenamed("label_raw", "label")
    with pytest.raises(ValueError, match="at fold 0 is empty"):
        learning.cross_validate(rows, ["a"], ["key"], LinearRegression(), "regression")


def test_looked_up_tree_values_are_those_of_the_formula(spark):
    run = learning.train(_rows(spark), "target", ["a", "b", "word"], ["key"], "regression", ["Random Forest"], trees=5)
    last = run.models["Random Forest"].stages[-1]
    vectors = run.models["Random Forest"].transform(run.train).select("features").toPandas()["features"]
    x = np.stack([v.toArray() for v in vectors])
    x = np.concatenate([x, x * 1.7, np.full((1, 3), np.nan)])
    (trees,) = tree_values.ensemble(spark, last, [0, 1, 2])
    grid = tree_values.Grid(trees)
    places = grid.places(x)
    for limit in (0, 2_000, 200_000):  # formula, patterns, cells
        tree_values.TABLE, kept = limit, tree_values.TABLE
        tables = [tree_values.looked_up(tree, grid) for tree in trees]
        tree_values.TABLE = kept
        for tree, table in zip(trees, tables):
            assert np.allclose(table(x, places).reshape(len(x), -1), tree_values.tree_shapley(tree, x).reshape(len(x), -1), atol=1e-12)


def test_a_small_file_is_dealt_by_the_matches_of_its_keys(spark, monkeypatch):
    monkeypatch.setattr(joining, "TASK_PAIRS", 1000)
    a = spark.range(200, numPartitions=1).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    b = spark.range(100, numPartitions=1).select(F.lit(1).alias("k"), F.col("id").alias("y"))
    for how in ("inner", "left", "right"):
        joined = joining.join_tables(a, b, "k", "k", how)
        assert joined.rdd.getNumPartitions() >= 20
        assert joined.select("x", "y").distinct().count() == joined.count() == 20_000


def test_kinds_of_columns_are_worked_out_once(spark):
    kinds = recommend._kinds(_rows(spark, 50).select("a", "word"))
    assert "Aggregate" not in kinds._jdf.queryExecution().executedPlan().toString()
    assert {r["column"]: r["kind"] for r in kinds.collect()} == {"a": "number", "word": "word"}
