import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tablecraft.operators import learning, mixtures


def table(spark):
    """160 rows, a tenth of them twice and one key null, with gaps in every feature."""
    rows = [(None if i == 7 else i, i % 3, None if i % 11 == 0 else float(i * 37 % 101), None if i % 13 == 0 else "xyz"[i * 7 % 3], float(i % 5), None) for i in range(160)]
    df = spark.createDataFrame(rows + rows[::10], "id long, part long, a double, w string, b double, none double")
    size = F.coalesce("a", F.lit(50.0)) + F.when(F.col("w") == "x", 40).otherwise(0) + F.col("b") * 3
    return df.withColumns({"size": size, "two": F.when(size > 80, "many").otherwise("few"),
                           "three": F.when(size > 100, "many").when(size > 60, "some").otherwise("few")})


@pytest.mark.parametrize("target, problem", [("size", "regression"), ("two", "classification"), ("three", "classification")])
def test_walks_equal_rows_of_coalitions(spark, monkeypatch, target, problem):
    keys, features = ["id", "part"], ["a", "w", "b", "none"]
    run = learning.train(table(spark), target, features, keys, problem, trees=3, rounds=2, one_hot=target == "two")
    assert len(run.models) >= 4
    hashed = run.train.withColumn("_h", F.xxhash64(*keys, F.lit(learning.SEED)))
    ground = hashed.orderBy(F.desc("_h"), *keys).limit(9)
    slow = {name: {r["feature"]: r["mean_abs_shap"] for r in learning._shap_by_rows(run, keys, name, hashed, ground, 3, 15).collect()} for name in run.models}
    monkeypatch.setattr(learning, "_shap_by_rows", None)  # every model of ``candidates`` is scored beside its rows
    for name in run.models:
        found = {r["feature"]: r["mean_abs_shap"] for r in learning.sampled_shap(run, keys, name, background=9, permutations=3).collect()}
        assert found == pytest.approx(slow[name], rel=1e-9, abs=1e-12), name
        assert max(found.values()) > 0


def test_mixtures_of_a_tree_of_many_leaves(spark):
    points = spark.range(3000).select(*[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 10).alias(c) for c in "abc"])
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(points.withColumn("label", F.sin("a") + F.col("b") * F.col("c")))
    model = DecisionTreeRegressor(maxDepth=9, seed=1).fit(rows)
    x = np.array([r["x"] for r in rows.limit(60).select(vector_to_array("features").alias("x")).collect()])
    ground, own = x[:10], x[10:]
    mix = mixtures.mixer(spark, model, [0, 1, 0], 2, 0)  # the first and third slot are one feature
    assert max(len(tree.said) for tree in mix.sums[0].trees) > 1
    pick = np.arange(50)[:, None] % 10
    rank = np.stack([np.zeros((50, 1), dtype=int), np.ones((50, 1), dtype=int)])
    told = mix.mixed(mix.parts(own), mix.parts(ground), pick, rank)[:, :, 0, 0]
    other = ground[pick[:, 0]]
    for step, mixed in enumerate([other, np.stack([own[:, 0], other[:, 1], own[:, 2]], axis=1), own]):
        asked = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(mixed)], "i int, a double, b double, c double")
        scored = model.transform(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(asked)).orderBy("i").collect()
        assert told[step].tolist() == [r["prediction"] for r in scored]


def test_copies_go_on_in_the_next_batch():
    import pyarrow as pa

    ids, x = [1, 1, 1, 2, 3, 3], [[1.0], [2.0], [4.0], [1.0], [5.0], [6.0]]
    sums = mixtures.Margins(np.array([[2.0]]), np.array([0.0]), [0], 1)
    run = mixtures.walks(mixtures.Mixer([sums], mixtures._same), np.array([[0.0]]), 1, 1)
    for cuts in ([6], [2, 6], [1, 2, 4, 5, 6], [3, 3, 6]):
        batches = [pa.RecordBatch.from_pydict({"a": pa.array(ids[i:j], pa.int64()), "b": pa.array(ids[i:j], pa.int64()), "x": pa.array(x[i:j], pa.list_(pa.float64())),
                                               "r": pa.array([[0, 5]] * (j - i), pa.list_(pa.int64()))}) for i, j in zip([0, *cuts], cuts)]
        [out] = run(iter(batches))
        assert out.to_pydict() == {"n": [3], "sums": [[pytest.approx(8 / 3 + 2 + 12 / 2)]]}
    assert not list(run(iter([])))
