from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tablecraft.operators import learning, tree_values


def table(spark, n=300):
    cell = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("double")
    rows = spark.range(n).select("id", cell(1, 9).alias("a"), cell(2, 7).alias("b"), cell(3, 5).alias("c"), cell(4, 6).alias("d"))
    rows = rows.withColumn("y", F.col("a") * F.col("b") + F.when(F.col("c") > 2, 10.0).otherwise(F.col("d")))
    rows = rows.withColumn("k", F.pmod(F.floor("y"), F.lit(3)).cast("double")).withColumn("two", (F.col("y") > 15).cast("double"))
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(rows)


def walk(nodes, players, x, known, chances, at=0):
    """Expected answer of a tree when only some features are known."""
    n = nodes[at]
    if n.left < 0:
        return np.asarray(n.stats) / sum(n.stats) if chances else np.array([n.prediction])
    goes = [(nodes[n.left], x[n.slot] <= n.cut[0]), (nodes[n.right], x[n.slot] > n.cut[0])]
    if players[n.slot] in known:
        return next(walk(nodes, players, x, known, chances, c.id) for c, ok in goes if ok)
    return sum(c.rows / n.rows * walk(nodes, players, x, known, chances, c.id) for c, _ in goes)


def by_subsets(trees, weights, players, x, chances):
    names = sorted(set(players))
    value = {}
    for size in range(len(names) + 1):
        for known in combinations(names, size):
            value[frozenset(known)] = sum(w * walk(t, players, x, set(known), chances) for t, w in zip(trees, weights))
    out = {}
    for i in names:
        out[i] = sum(
            factorial(len(s)) * factorial(len(names) - len(s) - 1) / factorial(len(names)) * (value[s | {i}] - value[s])
            for s in value if i not in s)
    return value[frozenset()], out


@pytest.mark.parametrize("players", [list("abcd"), list("abba")])
@pytest.mark.parametrize("kind", ["tree", "forest", "boosting", "classes"])
def test_equals_all_coalitions(spark, kind, players):
    rows = table(spark)
    estimator = {"tree": DecisionTreeRegressor(labelCol="y", maxDepth=6), "forest": RandomForestRegressor(labelCol="y", numTrees=4, seed=3),
                 "boosting": GBTRegressor(labelCol="y", maxIter=4, seed=3), "classes": RandomForestClassifier(labelCol="k", numTrees=3, seed=3)}[kind]
    model = estimator.fit(rows)
    nodes = tree_values.node_table(spark, model)
    trees = [{n.id: n for n in g.itertuples()} for _, g in nodes.groupby("tree")]
    weights = list(model.treeWeights) if kind == "boosting" else [1 / len(trees)] * len(trees)
    some = rows.where("id < 12")
    found = {(r["id"], r["output"]): r for r in tree_values.explained(some, model, players, ["id"]).collect()}
    for r in some.collect():
        base, told = by_subsets(trees, weights, players, r["features"].toArray(), kind == "classes")
        for o in range(len(base)):
            got = found[r["id"], str(o) if len(base) > 1 else None]
            assert got["base"] == pytest.approx(base[o], abs=1e-9)
            assert got["contributions"] == pytest.approx({c: v[o] for c, v in told.items()}, abs=1e-9)


def test_sums_are_predictions_and_margins(spark):
    rows = table(spark)
    forest = RandomForestClassifier(labelCol="k", numTrees=5, seed=1).fit(rows)
    boosted = GBTClassifier(labelCol="two", maxIter=5, seed=1).fit(rows)
    each = OneVsRest(classifier=GBTClassifier(maxIter=2, seed=1), labelCol="k").fit(rows)
    total = F.col("base") + F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, v: a + v)
    for model, column, place in ((forest, "probability", F.col("output").cast("int")), (boosted, "rawPrediction", F.lit(1)),
                                 (each, "rawPrediction", F.col("output").cast("int"))):
        told = tree_values.explained(rows, model, list("abcd"), ["id"]).withColumn("total", total)
        both = told.join(model.transform(rows).select("id", vector_to_array(column).alias("v")), "id")
        off = both.where(F.abs(F.col("total") - F.get("v", place)) > 1e-9).count()
        assert off == 0 and told.count() == rows.count() * (1 if model is boosted else 3)


def test_a_single_leaf_explains_nothing(spark):
    rows = table(spark, 20).withColumn("same", F.lit(4.0))
    model = DecisionTreeRegressor(labelCol="same").fit(rows)
    told = tree_values.explained(rows, model, list("abcd"), ["id"]).collect()
    assert len(told) == 20 and all(r["base"] == 4.0 and set(r["contributions"].values()) == {0.0} for r in told)
    assert tree_values.explained(rows.limit(0), model, list("abcd"), ["id"]).count() == 0


def test_names_of_results_are_refused(spark):
    rows = table(spark, 20).withColumnRenamed("id", "base")
    model = DecisionTreeRegressor(labelCol="y").fit(rows)
    with pytest.raises(ValueError, match="base"):
        tree_values.explained(rows, model, list("abcd"), ["base"])


def test_one_hot_levels_are_one_player(spark):
    rows = spark.range(200).select("id", F.concat(F.lit("w"), F.col("id") % 4).alias("w"), (F.col("id") % 9).cast("double").alias("x"))
    rows = rows.withColumn("y", F.when(F.col("w") == "w1", 50.0).otherwise(F.col("x")))
    run = learning.train(rows, "y", ["w", "x"], ["id"], "regression", models=["Random Forest"], trees=5, one_hot=True)
    told = tree_values.tree_values(run, ["id"])
    assert {frozenset(r["contributions"]) for r in told.collect()} == {frozenset({"w", "x"})}
    best = tree_values.tree_shap(run, ["id"]).collect()
    assert [r["feature"] for r in best] == ["w", "x"] and told.count() == run.train.count()
